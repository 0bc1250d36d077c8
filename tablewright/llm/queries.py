"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, minhash, packing, pii, quality, secrets, simhash, token_counts, topk, warc, whitening
from .common import documents

#: Path of the vocabulary file; a parameter of the operators.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(documents(spark, sf_dir))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded_rows(documents(spark, sf_dir), vocabulary_path())


def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(documents(spark, sf_dir), vocabulary_path())


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_rows(documents(spark, sf_dir))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_rows(documents(spark, sf_dir), vocabulary_path())


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*own.columns).unionByName(own))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifier_rows(documents(spark, sf_dir))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op1_exact_top_k": exact_top_k,
    "op2_simhash": simhash_groups,
    "op3_quality_rules": quality_rules,
    "op4_bpe_round_trip": bpe_round_trip,
    "op5_warc_bundles": warc_bundles,
    "op6_packing": sequence_packing,
    "op7_secret_ledger": secret_ledger,
    "op8_token_counts": token_lengths,
    "op9_chat_format": chat_format,
    "op10_personal_data": personal_data,
    "op11_whitening": embedding_whitening,
    "op12_collocations": phrase_collocations,
    "op13_minhash": minhash_groups,
}

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# Matches and the pieces between them give the places, for each kind on its own.
_SECRETS = r"""WITH p(kind, rank, pattern) AS (VALUES
    ('assign', 1, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    ('access', 2, 'AKIA[A-Z0-9]+'), ('hex', 3, '[0-9a-f]+')),
  d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
  m AS (SELECT id, kind, rank, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gs FROM d, p WHERE regexp_matches(t, pattern)),
  u AS (SELECT id, kind, rank, unnest(ms) AS match, unnest(gs[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM m),
  w AS (SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY id, kind ORDER BY i) AS BIGINT) AS stop FROM u),
  s AS (SELECT id, kind, rank, stop - length(match) AS start, stop FROM w WHERE CASE kind WHEN 'access' THEN length(match) >= 18
    WHEN 'hex' THEN length(match) >= 16
    ELSE length(regexp_extract(match, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 END),
  g AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)"""

_CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(n))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|><|says|><|end|>') + 1 + length(replace(replace(role || text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?
-]')) AS piece FROM documents),
  w AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) s(k)),
  f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
  t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
  u AS (SELECT lang, k, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:k], ' ') AS tail FROM c, range(1, 3) s(i) WHERE i < k),
  s AS (SELECT u.lang, u.k, u.phrase, u.a, u.i, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * u.a * u.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
  i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
  m AS (SELECT lang, phrase, max(a) AS longest FROM i GROUP BY ALL),
  k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM b LEFT JOIN m USING (lang, phrase) WHERE b.k = 3 OR m.longest IS NULL OR 100 * m.longest < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang) WHERE rank <= 2000"""

# Pairs that share a shingle, and the links among them; reachability by a recursive step over the links.
_MINHASH = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id,
    list_filter(string_split_regex({_LOW}, '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT id, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingles FROM d),
  u AS (SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
  e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  r AS (SELECT id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
  c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (id)"""

#: The other results come from methods that SQL does not express (components, estimates, codes, packing); tests/llm
#: compares them with the library or brute force.
ORACLES: dict[str, str] = {"op1_exact_top_k": _TOP_K, "op7_secret_ledger": _SECRETS, "op9_chat_format": _CHAT, "op12_collocations": _COLLOCATIONS, "op13_minhash": _MINHASH}
