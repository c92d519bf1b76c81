"""The table of frequent pre-tokens, from summaries of all documents."""

import random
from collections import Counter

from pointprep.llm import token_counts as tc
from pointprep.llm.bpe import PRE_TOKEN


def test_frequent_words_of_all_documents_are_found(docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["common", "often", "again"]) if rng.random() < 0.5 else f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    # Only the last rows hold this one.
    texts += ["rare but frequent there " * 5] * 30
    table = docs(list(enumerate(texts))).repartition(23)
    found = tc.frequent_pre_tokens(table, n=50, size=400, fan_in=3)
    total = Counter(w for t in texts for w in PRE_TOKEN.findall(t))
    must = {w for w, c in total.items() if c > sum(total.values()) / 400 * 2}
    assert must <= set(found) and len(found) <= 50 and " frequent" in must


def test_summaries_lose_no_more_than_their_error():
    found = Counter({f"w{i}": 1 + i % 7 for i in range(1000)}) + Counter({"a": 500, "b": 90})
    small = tc.shrink(found, 100)
    assert len(small) <= 100 and all(found[w] - sum(found.values()) / 100 <= n <= found[w] for w, n in small.items())
    assert small["a"] > 450


def test_no_documents(docs):
    assert tc.frequent_pre_tokens(docs([])) == []
