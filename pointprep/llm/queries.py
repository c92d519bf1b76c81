"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointprep.llm import ann, bpe, centroids, chat_format, fingerprints, html_wrappers, mixing, prefix_trie, simhash
from pointprep.llm import substring_dedup, suffix_dedup, token_counts, toxicity
from pointprep.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    """Where the public vocabulary lies on this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op4_bpe_round_trip")
def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"), vocabulary())


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), limit=1024)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


@query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, copies=2)


@query("op9_simhash_classes")
def op9_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(read_table(spark, sf_dir, "documents"))


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(read_table(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(read_table(spark, sf_dir, "documents"), window=50)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(read_table(spark, sf_dir, "documents"), window=400)


def rebuilt_paths(convs: DataFrame) -> DataFrame:
    """Conversations that begin like the one whose number is the multiple of five below."""
    c = F.col("conv_id")
    return prefix_trie.replace_heads(prefix_trie.conversation_paths(convs), c - c % 5, F.crc32(c.cast("string")) % 9)


#: A node is named by its digest path; ancestors of a node are the rows of its smallest member. CRC-32 is worked out bit by bit.
OP11_SQL = """
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, k, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, k) AS p
    FROM (SELECT conv_id, turn, r, substr(sha256(length(r) || ':' || r || t), 1, 32) AS k, strlen(t) AS b FROM src)
),
ids AS (
    SELECT conv_id AS c, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda acc, ch: list_reduce(
            list_prepend(xor(acc, ch), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
        )
    ), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM src)
),
turns AS (
    SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM (
        SELECT c, 0 AS part, p, k, b FROM ids JOIN own ON own.conv_id = c - c % 5 AND p <= h
        UNION ALL SELECT c, 1, p, k, b FROM ids JOIN own ON own.conv_id = c AND p > h
    )
),
steps AS (
    SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS node, b FROM turns
    UNION ALL SELECT c, 0, '', 0 FROM ids
),
nodes AS (SELECT node, any_value(d) AS d, min(c) AS least, count(*) AS n, any_value(b) AS b FROM steps GROUP BY node),
kids AS (SELECT node[:-33] AS up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.node),
below AS (
    SELECT steps.node, sum((n - 1) * whole.b) AS saved, count(*) FILTER (n_children = 0) AS leaves
    FROM whole JOIN steps ON steps.c = whole.least AND steps.d <= whole.d GROUP BY steps.node
),
ends AS (
    SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS numbers
    FROM (SELECT node, c, d, max(d) OVER (PARTITION BY c) AS last FROM steps) WHERE d = last GROUP BY node
)
SELECT whole.least AS conv_id, whole.d AS depth, up.least AS parent_conv_id, whole.n AS n_convs, whole.n_children,
    below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(ends.numbers, '')) AS ends_sha256
FROM whole JOIN below USING (node) LEFT JOIN ends USING (node)
LEFT JOIN nodes AS up ON whole.d > 0 AND up.node = whole.node[:-33]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt_paths(read_table(spark, sf_dir, "conversations")))


ESCAPE_CASE = "\\### Assistant: </turn> ok"


def with_escape_case(convs: DataFrame) -> DataFrame:
    """Conversations and number -7, whose texts hold control strings and an escape."""
    case = convs.sparkSession.createDataFrame(
        [(-7, 0, "user", ESCAPE_CASE), (-7, 1, "assistant", ESCAPE_CASE)], "conv_id long, turn long, role string, text string"
    )
    return convs.select("conv_id", "turn", "role", "text").unionByName(case)


OP12_SQL = r"""
WITH src AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
),
turns AS (
    SELECT *, lag(r) OVER w AS before, row_number() OVER w AS p,
        count(*) OVER (PARTITION BY conv_id) AS n,
        length(t) + length(t) - length(replace(t, '\', '')) + (length(t) - length(replace(t, '</turn>', ''))) // 7
            + (length(t) - length(replace(t, '</role>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(t, '#{3,}'), lambda x: length(x) - 2)), 0) AS text_chars,
        length(r) + length(r) - length(replace(r, '\', '')) + (length(r) - length(replace(r, '</turn>', ''))) // 7
            + (length(r) - length(replace(r, '</role>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(r, '#{3,}'), lambda x: length(x) - 2)), 0) AS role_chars
    FROM src WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)
),
judged AS (
    SELECT *, CASE
        WHEN p = 1 THEN r IN ('system', 'user')
        WHEN before IN ('system', 'assistant') THEN r = 'user'
        WHEN before = 'user' THEN r = 'assistant'
        ELSE false END AS accepted,
        CASE r WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 17 + role_chars END AS head
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY p)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY p) FILTER (r = 'assistant'), '')) AS loss_sha256,
    sum(head + text_chars + 8)::BIGINT AS formatted_chars,
    count(*) FILTER (NOT accepted) AS n_faults,
    bool_and(accepted) AND bool_or(p = n AND r = 'assistant') AS valid
FROM judged GROUP BY conv_id
"""


@query("op12_chat_format", OP12_SQL)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.format_turns(with_escape_case(read_table(spark, sf_dir, "conversations"))))


def _op13_sql(k: int, rounds: int, seed: int, scale: int, dims: int) -> str:
    """Each round as two steps: nearest centroid of every row, then the floor of each component's mean."""
    gap = "list_sum(list_transform(list_zip(x, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dims}
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS p
    FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT row, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT row, c, {gap} AS d FROM kept, c{i}) GROUP BY row)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
    SELECT c, nr, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v
    FROM (SELECT c, unnest(x) AS v, unnest(range({dims})) AS nr FROM a{i} JOIN kept USING (row)) GROUP BY c, nr
),
c{i + 1} AS MATERIALIZED (
    SELECT c{i}.c, coalesce(any_value(q), any_value(c{i}.p)) AS p
    FROM c{i} LEFT JOIN (SELECT c, list(v::BIGINT ORDER BY nr) AS q FROM m{i} GROUP BY c) AS moved ON moved.c = c{i}.c GROUP BY c{i}.c
)""")
    return ",".join(steps) + f"""
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


@query("op13_centroids", _op13_sql(40, 5, 2, 256, 64))
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, scale=256, dims=64)
