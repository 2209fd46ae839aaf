"""The queries of the training-data operators and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe import round_trip_bpe
from .chat import fit_hmm, format_chats, raw_transcripts
from .common import write_shared
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .langid import language_id
from .line_dedup import line_dedup
from .mixing import REST, mix_sources
from .token_store import read_tokens, write_tokens
from .toxicity import toxicity

WORD_SPACE = r"[\x20\x09-\x0D]+"
TRIM_SET = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {TRIM_SET}), {A_Z}) AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS dropped FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir)).drop("row_key")


OP10_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {A_Z}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    folder, manifest = write_tokens(_docs(spark, sf_dir), tokenizers.path("word_bpe_49k.json"), 49_408, end_id=1)
    return read_tokens(spark, folder, manifest)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_docs(spark, sf_dir))


# every pair that shares a shingle, then the least id by links; at small sizes
OP4_SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {A_Z}), '{WORD_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i+4], ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.y, r.c FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) l ON l.x = r.doc_id AND r.c < l.y)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe_digests(_docs(spark, sf_dir), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)


def bpe_digests(docs: DataFrame, vocabulary: str, pattern: str, longs: tuple[str, ...] = ()) -> DataFrame:
    """Encode, decode the ids, and digest both; columns ``longs`` pass through."""
    coded = round_trip_bpe(docs, vocabulary, pattern, longs=longs)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        *longs,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


#: Target weights of the mixing query: shares of named sources, and of all others together.
MIX_SHARES, MIX_REST, MIX_BLOCK = {"src0": 6, "src1": 5, "src2": 4, "src3": 3, "src4": 2}, 10, 16


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return mix_sources(docs, MIX_SHARES, MIX_REST, MIX_BLOCK)


_MIX = MIX_SHARES | {REST: MIX_REST}
_MIX_D = sum(_MIX.values())
OP6_SQL = f"""
WITH RECURSIVE
c AS (SELECT {list(_MIX)} AS names, {list(_MIX.values())} AS shares, {_MIX_D} AS d),
sim AS (
  SELECT -1 AS t, {[0] * len(_MIX)} AS done, NULL::BIGINT AS pick
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, list_min(list_transform(done, lambda x, i:
          CASE WHEN x < shares[i] AND (x * d) // shares[i] <= t + 1 THEN ((x + 1) * d + shares[i] - 1) // shares[i] * 1000 + i END)) % 1000 AS p, d
        FROM sim, c) WHERE t + 1 < d),
period AS (SELECT names[pick] AS cls, shares[pick] AS share, d, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sim, c WHERE t >= 0),
k AS (SELECT doc_id, source, CASE WHEN source IN ({", ".join(repr(x) for x in MIX_SHARES)}) THEN source ELSE '{REST}' END AS mix_class, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_class ORDER BY h) - 1 AS mix_rank FROM k),
b AS (SELECT *, mix_rank // {MIX_BLOCK} AS mix_block FROM r)
SELECT doc_id, source, mix_class, mix_rank, mix_block, (mix_block // share) * d + slot AS mix_slot, (mix_rank % {MIX_BLOCK})::INT AS mix_pos
FROM b JOIN period ON mix_class = cls AND mix_block % share = nth
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_docs(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw logs, one marker in five lost; what comes back, beside the roles of the table.

    n_right: lines whose role is that of the table.
    """
    raw = write_shared(raw_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "transcripts")
    found = format_chats(raw, fit_hmm(raw))
    lines = F.flatten(F.transform("truth", lambda t: F.array_repeat(t["role"], t["lines"])))
    true = raw.select("conv_id", "segment", "part", F.transform("truth", lambda t: t["role"]).alias("true_roles"), lines.alias("true_lines"))
    both = found.join(true, found["conv_id"].eqNullSafe(true["conv_id"]) & (found["segment"] == true["segment"]) & (found["part"] == true["part"])).select(found["*"], "true_roles", "true_lines")
    right = F.filter(F.zip_with("line_roles", "true_lines", lambda x, y: x.eqNullSafe(y)), lambda x: x)
    return both.select(
        "conv_id",
        "segment",
        "part",
        "n_lines",
        F.size(right).cast("long").alias("n_right"),
        F.size("roles").cast("long").alias("n_turns"),
        "continues",
        F.array_join("roles", ",").alias("roles"),
        F.array_join("true_roles", ",", "?").alias("true_roles"),
        F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, sf_dir)).drop("char_distance", "word_distance")


def _op9_sql(min_words: int = 20, guard: int = 60, most_char: float = 0.25, most_word: float = 0.275) -> str:
    steps, left = "", "t"
    for i, (_, pattern) in enumerate(quality.CLASSES):
        pattern = pattern.replace("'", "''")
        steps += f", regexp_replace({left}, '{pattern}', '', 'g') AS x{i}"
        left = f"x{i}"
    texts = ["t", *(f"x{i}" for i in range(len(quality.CLASSES)))]
    char_hist = ", ".join([*(f"length({a}) - length({b})" for a, b in zip(texts, texts[1:], strict=False)), f"length({left})"])
    one = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}'))" for w in quality.WORDS)
    langs = ", ".join(repr(x) for x in quality.COMMON_WORDS)
    n_char, n_word = len(quality.CLASSES) + 1, len(quality.WORDS) + 1
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i + 1}])::DOUBLE" for i in range(n)) + "]"
    term = lambda p: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    js = lambda h, r: (
        f"CASE WHEN list_sum({h}) > 0 AND list_sum({r}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip(list_transform({h}, lambda x: x / list_sum({h})), "
        f"list_transform({r}, lambda x: x / list_sum({r}))), lambda z: {term('z[1]')} + {term('z[2]')})) / 2, 0)) END"
    )
    return f"""
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{quality.SPACE}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
x AS (SELECT * FROM a),
{_chain(steps)}
h AS (SELECT doc_id, lang, len(ws) AS n_words, length(t) - (length(x0) - length(x1)) AS word_chars,
             length({left}) - length(regexp_replace({left}, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, [{char_hist}] AS ch, [{one}] AS c0 FROM y{len(quality.CLASSES) - 1}),
b AS (SELECT h.*, coalesce(cov.n, 0) AS n_repeat_words, n_words < {min_words} OR 100 * coalesce(cov.n, 0) > 30 * n_words AS base_failed,
             list_append(c0, n_words - list_sum(c0)) AS wh FROM h LEFT JOIN cov USING (doc_id)),
ref AS (SELECT lang AS rl, {sums("ch", n_char)} AS rc, {sums("wh", n_word)} AS rw FROM b WHERE NOT base_failed AND lang IN ({langs}) GROUP BY lang),
far AS (SELECT doc_id, min({js("ch", "rc")}) AS dc, min({js("wh", "rw")}) AS dw FROM b, ref GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {guard} AND (coalesce(dc > {most_char}, false) OR coalesce(dw > {most_word}, false))) AS kept
FROM b LEFT JOIN far USING (doc_id)
"""


def _chain(steps: str) -> str:
    """One CTE for each successive replacement, as each reads the one before."""
    parts, before = [], "x"
    for i, step in enumerate(x for x in steps.split(", regexp_replace(")[1:]):
        parts.append(f"y{i} AS (SELECT *, regexp_replace({step} FROM {before}),")
        before = f"y{i}"
    return "\n".join(parts)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_store": op2_token_store,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op4_jaccard_join": OP4_SQL, "op6_mixing": OP6_SQL, "op9_quality": _op9_sql(), "op10_exact_dedup": OP10_SQL}
