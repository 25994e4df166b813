"""The registered queries of the training-data operators, with DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run
    return deco


def joined_digest(items):
    """Lowercase hex SHA-256 of the sorted, comma-joined strings."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


# --- 1 ------------------------------------------------------------------------

def _escaped_sql(x: str) -> str:
    from .chat_format import ESCAPES
    out = f"replace({x}, '\\', '\\\\')"
    for plain, broken in ESCAPES:
        out = f"replace({out}, '{plain}', '{broken}')"
    return out


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + 11 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n)
SELECT conv_id, max(n)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@register("op1_chat_formatting", OP1_SQL)
def op1(spark, sf_dir):
    """Digests read back from the formatted examples of all conversations."""
    from .chat_format import format_conversations, read_back
    planted = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(format_conversations(turns.unionByName(planted)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


# --- 7 ------------------------------------------------------------------------

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Reachability over links(x, y) in both directions, one row per row number.
_REACH = """reach AS (
  SELECT rid AS x, rid AS y FROM d
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)"""


def _words_sql(table_name: str, key: str, pattern: str) -> str:
    return (f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all("
            f"translate(coalesce(text, ''), {_AZ}), '{pattern}') AS w FROM {table_name}")


OP7_SQL = f"""
WITH d AS ({_words_sql('documents', 'doc_id', r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')}),
b AS ({_words_sql('benchmark', 'CAST(item_id AS VARCHAR) AS item', r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')}),
s AS (SELECT item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w
      FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM s),
places AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w
           FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT p.rid, p.i, p.n, x.item FROM places p
          JOIN windows x ON x.n = p.n AND x.g = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit
          FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


@register("op7_benchmark_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    """Words of every document inside occurrences of benchmark windows."""
    from .decontaminate import item_blocks, n_hit, with_matches
    blocks = item_blocks(table(spark, sf_dir, "benchmark"))
    found = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), blocks, "m", window=10)
    hit = n_hit(F.col("m"))
    return found.select(
        "doc_id", F.col("m.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("m.items").cast("long").alias("n_items"),
        joined_digest(F.array_sort("m.items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


# --- 9 ------------------------------------------------------------------------

@register("op9_license_scans")
def op9(spark, sf_dir):
    """License notices in every document, exact and with few edits."""
    from .license_scan import NOTICES, scan_column
    base = [n.text for n in NOTICES if n.base]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", scan_column(F.col("text")).alias("m"))
    exact = F.filter("m.spans", lambda s: s["exact"] & s["notice"].isin(base))
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(
        F.transform(spans, lambda s: s["label"]))), ",")
    likeness = F.transform("m.spans", lambda s: 1.0 - s["edits"] / F.length(s["notice"]))
    return found.select("doc_id", "m", exact.alias("exact")).select(
        "doc_id", F.col("m.n_words").alias("n_words"), F.size("exact").cast("long").alias("n_base"),
        F.array_min(F.transform("exact", lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform("exact", lambda s: s["first_word"])).alias("last_word"),
        label(F.col("exact")).alias("base_labels"), label(F.col("m.spans")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"))


# --- 2 ------------------------------------------------------------------------

@register("op2_language_id")
def op2(spark, sf_dir):
    """Language of every whole text; learned from the rows not held out."""
    from .common import is_training_row
    from .language_id import fit, predict
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(is_training_row(F.col("doc_id"))).select("doc_id", "text", "lang"))
    shared = spark.sparkContext.broadcast(model)
    found = docs.select("doc_id", predict(F.col("text"), shared).alias("p"))
    return found.select("doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"),
                        F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


# --- 4 ------------------------------------------------------------------------

@register("op4_toxicity")
def op4(spark, sf_dir):
    """Toxicity score of every whole text; learned from the rows not held out."""
    from .common import is_training_row
    from .toxicity import fit, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    weights = fit(docs, labels.where(is_training_row(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(weights)
    found = docs.select("doc_id", score(F.col("text"), shared).alias("score"))
    return found.select("doc_id", (~is_training_row(F.col("doc_id"))).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- 6 ------------------------------------------------------------------------

@register("op6_html_extraction")
def op6(spark, sf_dir):
    """Visible text of every page, laid out."""
    from .html_render import rendered
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", rendered("html").alias("text")).select(
        "page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


# --- 5 ------------------------------------------------------------------------

#: The key of the registered query and of the pipeline; a user passes their own.
PSEUDONYM_KEY = "example-key"


@register("op5_pii")
def op5(spark, sf_dir):
    """Every document with its private values replaced by pseudonyms."""
    from .pii import pseudonymise
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, PSEUDONYM_KEY, found="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"),
                      F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


# --- 3 ------------------------------------------------------------------------

@register("op3_source_mixing")
def op3(spark, sf_dir):
    """Words that the mix takes from every document."""
    from .mixing import blocks_and_slots, size_documents, source_targets, with_source_number, words_taken
    sized = size_documents(table(spark, sf_dir, "documents"))
    sources = source_targets(sized)
    taken = words_taken(*blocks_and_slots(sized, sources)).select("src", "doc_id", "size", "taken")
    wordless = with_source_number(sized.where(F.col("size") == 0), sources).select(
        "src", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(wordless).join(sources, "src").select(
        "doc_id", "size", "source_size", "target", "taken")


# --- 10 -----------------------------------------------------------------------

OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT rid, v, sqrt(list_dot_product(v, v)) AS norm FROM d
      WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(v, v) > 0),
links AS (SELECT a.rid AS x, b.rid AS y FROM u a JOIN u b ON a.rid <> b.rid AND len(a.v) = len(b.v)
          WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
{_REACH},
c AS (SELECT x, min(o.vec_id) AS component_id FROM reach JOIN d o ON o.rid = y GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id,
       coalesce(d.vec_id = component_id, false) AS kept
FROM d JOIN c ON c.x = d.rid LEFT JOIN n ON n.x = d.rid"""


@register("op10_embedding_near_dedup", OP10_SQL)
def op10(spark, sf_dir):
    """Links and components of all vectors at cosine 0.95."""
    from .embedding_dups import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# --- 8 ------------------------------------------------------------------------

OP8_SQL = f"""
WITH RECURSIVE d AS ({_words_sql('documents', 'doc_id', r'[^\x20\x09-\x0D]+')}),
s AS (SELECT rid, unnest(list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
        list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END)) AS g
      FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.rid = x JOIN n b ON b.rid = y
          WHERE 100 * common >= 85 * (a.n + b.n - common)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.rid = d.rid JOIN reach r ON r.x = d.rid JOIN d o ON o.rid = r.y
GROUP BY d.rid, d.doc_id, n.n"""


@register("op8_ngram_jaccard_join", OP8_SQL)
def op8(spark, sf_dir):
    """Components of all documents at a 4-word Jaccard similarity of 0.85."""
    from .ngram_join import Jaccard, near_duplicates
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Jaccard(words=4, share=85)).select("doc_id", "n_shingles", "component_id")


# --- 11 -----------------------------------------------------------------------

def _coded_sql(column: str, value: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || "
            f"CAST({value} AS VARCHAR) END")


def _leaf_sql(text: str) -> str:
    coded = [_coded_sql(c, text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return f"sha256({' || '.join(coded)})"


def _tree_sql(first: str, prefix: str) -> str:
    """Nodes and runs of three of the trees whose leaves are ``first(source, pos, h, n)``."""
    return f"""{prefix}nodes AS (
  SELECT 0 AS lvl, source, pos, h, n FROM {first}
  UNION ALL SELECT lvl + 1, source, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM {prefix}nodes WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
{prefix}runs AS (SELECT lvl, source, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM {prefix}nodes WHERE n > 1
  GROUP BY lvl, source, pos // 3)"""


def _fold_sql(first: str, prefix: str) -> str:
    """The way up from ``first(rid, source, pos, n, cur, sibs)`` to the top."""
    return f"""{prefix}fold AS (
  SELECT rid, source, 0 AS lvl, pos, n, cur, sibs FROM {first}
  UNION ALL SELECT rid, f.source, f.lvl + 1, pos // 3, (n + 2) // 3,
    sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = pos % 3 + 1 THEN cur ELSE x END), '')),
    sibs || array_to_string(list_filter(hs, lambda x, i: i <> pos % 3 + 1), '')
  FROM {prefix}fold f JOIN {prefix}runs r ON r.lvl = f.lvl AND r.source IS NOT DISTINCT FROM f.source AND r.up = f.pos // 3
  WHERE n > 1)"""


#: Columns of DuckDB have no crc32: the ids whose unsigned crc32 is even are
#: found bit by bit, from the linear form of the check sum's last bit.
def _even_crc_sql(value: str) -> str:
    import zlib
    # crc32(a ^ b ^ c) of equal lengths is the exclusive or of their crc32s,
    # so the last bit is a parity over the bits of the text
    cases = []
    for length in range(1, 21):
        zero = zlib.crc32(bytes(length)) & 1
        masks = [sum(((zlib.crc32(bytes(i) + bytes([1 << b]) + bytes(length - i - 1)) & 1) ^ zero) << b for b in range(8))
                 for i in range(length)]
        parity = " + ".join(f"bit_count(ascii(substr({value}, {i + 1}, 1)) & {m})" for i, m in enumerate(masks) if m) or "0"
        cases.append(f"WHEN {length} THEN ({parity} + {zero}) % 2 = 0")
    return f"CASE length({value}) {' '.join(cases)} END"


OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, *, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_even_crc_sql("CAST(doc_id AS VARCHAR)")} THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
l AS (SELECT rid, doc_id, source, leaf AS h, coalesce(tampered, leaf) AS cur, '' AS sibs,
       row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
       count(*) OVER (PARTITION BY source) AS n FROM docs),
{_tree_sql('l', 'a_')},
{_fold_sql('l', 'a_')},
tops AS (SELECT source AS name, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM a_nodes WHERE n = 1),
t AS (SELECT 0 AS source, pos, h, n FROM tops),
{_tree_sql('t', 'b_')},
u AS (SELECT f.rid, 0 AS source, t.pos, t.n, f.cur, f.sibs FROM a_fold f JOIN tops t ON t.name IS NOT DISTINCT FROM f.source
  WHERE f.n = 1),
{_fold_sql('u', 'b_')}
SELECT l.doc_id, l.h AS leaf, tops.h AS subroot, r.h AS root, sha256(f.sibs) AS proof_sha256,
       f.cur AS folded_root, f.cur = r.h AS verified
FROM l JOIN tops ON tops.name IS NOT DISTINCT FROM l.source JOIN b_fold f ON f.rid = l.rid AND f.n = 1
JOIN (SELECT h FROM b_nodes WHERE n = 1) r ON true"""


@register("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    """Leaf, roots, proof and the root of the tampered version of every document."""
    from .merkle import leaf_digest, manifest
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: leaf_digest(*[F.col(c) for c in columns], text)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"),
                       F.when(even, leaf(F.regexp_replace("text", "\n", ""))).alias("changed"))
    made = manifest(rows, "source", "doc_id", "leaf", "changed")
    return made.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


# --- 12 -----------------------------------------------------------------------

@register("op12_token_counts")
def op12(spark, sf_dir):
    """Bytes and tokens of every whole text."""
    import public_tokenizers
    from .token_counts import Vocabulary, token_counts
    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


# --- 13 -----------------------------------------------------------------------

_TERMS_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13_SQL = f"""
WITH d AS ({_words_sql('documents', 'doc_id', _TERMS_SQL)}),
b AS ({_words_sql('benchmark', 'item_id', _TERMS_SQL)}),
c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT rid, term, count(*) AS times FROM (SELECT rid, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT rid, doc_id, 75 + (25 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT q.rid, m.doc_id, sum(q.times * t.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN m ON m.rid = p.rid GROUP BY q.rid, m.rid, m.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT b.item_id, r.rank, r.doc_id, r.score FROM r JOIN b USING (rid) WHERE r.rank <= 20"""


@register("op13_ranked_lexical_search", OP13_SQL)
def op13(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    from .ranked_search import build_index, search
    index, n_docs = build_index(table(spark, sf_dir, "documents"))
    return search(index, n_docs, table(spark, sf_dir, "benchmark"))
