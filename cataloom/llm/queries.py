"""Registered queries of the operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, read
from .conversations import damage, repair_report
from .decontaminate import contamination
from .extract import extract
from .huffman import round_trip
from .language import language
from .line_dedup import dedup_lines
from .merkle import fold, leaf_hash, manifest, siblings
from .ngram_join import near_duplicates
from .packing import pack_documents
from .quality import quality
from .sharding import shard_rows
from .topk import top_k
from .toxicity import toxicity
from .training import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "list_filter(regexp_split_to_array(translate({0}, '" + _UPPER + "', '" + _LOWER + "'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = ("CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))"
             " WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END")


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


@query("op4_ngram_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, {_SHINGLES} AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op1_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, lens WHERE len(ws) >= n)),
o AS MATERIALIZED (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# DuckDB has no crc32: the SQL leaves text_crc32 to the tests.
@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_rows(docs, 8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 4, 2)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(5, 0), "score", "predicted")


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), keep=("ids_crc32",))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(3, 1), "score", "predicted")


@query("op8_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_LINE_WORDS = _SPLIT.format("line")


@query("op10_line_dedup", f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i - 1 AS line, ls[i] AS line_text, {_SPLIT.format("ls[i]")} AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
s AS (SELECT doc_id, line, list_sort({_SHINGLES}) AS sh FROM u WHERE len(ws) > 0),
g AS MATERIALIZED (SELECT sh, min((doc_id, line)) AS first, row_number() OVER () AS id FROM s GROUP BY sh),
e AS MATERIALIZED (SELECT id, first, len(sh) AS n, unnest(sh) AS x FROM g),
p AS MATERIALIZED (SELECT b.id FROM e a JOIN e b ON a.x = b.x AND a.first < b.first GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT s.doc_id, s.line FROM s JOIN g ON s.sh = g.sh WHERE (s.doc_id, s.line) > g.first OR g.id IN (SELECT id FROM p)),
k AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM r GROUP BY doc_id),
f AS (SELECT u.doc_id, string_agg(u.line_text, chr(10) ORDER BY u.line) FILTER (WHERE r.line IS NULL) AS kept
      FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.line = u.line GROUP BY u.doc_id)
SELECT d.doc_id, CAST(coalesce(len(t.ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


# crc32 of a text, bit by bit: DuckDB has no such function.
_CRC = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({0}) + 1), lambda i: list_prepend(CAST(ascii({0}[i]) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),"
        " lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)")
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"


@query("op13_merkle", f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('g' || source, '') AS g, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT 0 AS lvl, g, pos, leaf AS h, n FROM l
      UNION ALL SELECT lvl + 1, g, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY lvl, g, pos // 3, n),
s AS MATERIALIZED (SELECT g, h, lvl AS top, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, h, n FROM s
      UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
a AS MATERIALIZED (SELECT g, lvl, pos, h FROM t WHERE n > 1
      UNION ALL SELECT s.g, s.top + u.lvl, u.pos, u.h FROM s JOIN u ON u.n > 1 AND u.pos // 3 = s.pos // CAST(pow(3, u.lvl + 1) AS BIGINT)),
p AS MATERIALIZED (SELECT l.doc_id, l.leaf, l.other, l.g, l.pos, s.h AS subroot, s.top, s.pos AS spot, row_number() OVER () AS id FROM l JOIN s ON s.g = l.g),
e AS MATERIALIZED (SELECT p.id, a.lvl, a.h, a.pos < x.own AS before, a.pos FROM p
      JOIN (SELECT p.id, i AS lvl, CASE WHEN i < p.top THEN p.pos // CAST(pow(3, i) AS BIGINT) ELSE p.spot // CAST(pow(3, i - p.top) AS BIGINT) END AS own
            FROM p, (SELECT DISTINCT lvl AS i FROM a)) x ON x.id = p.id
      JOIN a ON a.g = p.g AND a.lvl = x.lvl AND a.pos // 3 = x.own // 3),
b AS MATERIALIZED (SELECT e.id, e.lvl, coalesce(string_agg(h, '' ORDER BY e.pos) FILTER (WHERE before), '') AS le,
      coalesce(string_agg(h, '' ORDER BY e.pos) FILTER (WHERE NOT before AND e.pos <> o.own), '') AS ri
      FROM e JOIN (SELECT p.id, i AS lvl, CASE WHEN i < p.top THEN p.pos // CAST(pow(3, i) AS BIGINT) ELSE p.spot // CAST(pow(3, i - p.top) AS BIGINT) END AS own
            FROM p, (SELECT DISTINCT lvl AS i FROM a)) o ON o.id = e.id AND o.lvl = e.lvl GROUP BY e.id, e.lvl),
f AS (SELECT id, 0 AS lvl, other AS h FROM p UNION ALL SELECT f.id, f.lvl + 1, sha256(le || h || ri) FROM f JOIN b ON b.id = f.id AND b.lvl = f.lvl),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, p.subroot, r.root, sha256(coalesce(q.sibs, '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM p, r JOIN (SELECT id, arg_max(h, lvl) AS h FROM f GROUP BY id) f ON f.id = p.id
LEFT JOIN (SELECT id, string_agg(le || ri, '' ORDER BY lvl) AS sibs FROM b GROUP BY id) q ON q.id = p.id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.when(F.coalesce(crc_bucket("doc_id", 2) == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    hashed = docs.select("doc_id", "source", leaf_hash(*fields, F.col("text")).alias("leaf"), leaf_hash(*fields, cut).alias("tampered"))
    found = manifest(hashed, keep=("tampered",)).withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# SQL has no HTML reader; tests hold the pages against their articles.
@query("op12_html_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# States: nothing 0, system 1, user 2, assistant 3. A step may insert a turn, then deletes, keeps or renames one.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FORCED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def _steps() -> str:
    """SQL rows (state, inserted line, state after, cost, letters, edit, initial of a kept turn, role)."""
    rows = []
    for state in range(4):
        for at, cost, letters, line in ((state, 0, "", ""), (_NEXT[state, _FORCED[state][0]], 2, "I", f"chr(10) || '{_FORCED[state]}:'")):
            rows.append((state, line or "''", at, cost + 3, letters + "D", "D", "", ""))
            rows += [(state, line or "''", to, cost, letters + "K", "K", initial, "") for (held, initial), to in _NEXT.items() if held == at]
            rows.append((state, line or "''", _NEXT[at, _FORCED[at][0]], cost + 2, letters + "R", "R", "", _FORCED[at]))
    return ", ".join(f"({a}, {b}, {c}, {d}, '{e}', '{f}', '{g}', '{h}')" for a, b, c, d, e, f, g, h in rows)


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_GROUP = "coalesce('c' || conv_id, '')"


@query("op11_conversation_repair", f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT {_GROUP} AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(" + _KEY + ")")} % 20 AS k FROM conversations),
x AS (SELECT g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT * FROM k WHERE k <> 0 UNION ALL SELECT * FROM k WHERE k = 3)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS n FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY n) AS seen FROM o),
f AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
      WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
      lag(left(role, 1)) OVER (PARTITION BY g ORDER BY n) AS before FROM r),
t(state, ins, after, cost, letters, edit, initial, role) AS (VALUES {_steps()}),
s AS (SELECT DISTINCT g, 0 AS n, 0 AS state, {{'c': 0, 'a': '', 'o': ''}} AS best FROM f
      UNION ALL SELECT s.g, s.n + 1, t.after, min({{'c': s.best.c + t.cost + CASE WHEN f.fault = 't' AND t.edit <> 'D' THEN 1 ELSE 0 END, 'a': s.best.a || t.letters,
          'o': s.best.o || t.ins || CASE t.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || t.role || ':' || f.text END}})
      FROM s JOIN f ON f.g = s.g AND f.n = s.n + 1 JOIN t ON t.state = s.state AND (t.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (t.edit = 'R' OR t.initial = f.initial))
      GROUP BY s.g, s.n, t.after),
c AS (SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
      count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
e AS (SELECT s.g, min(CASE s.state WHEN 2 THEN {{'c': s.best.c + 2, 'a': s.best.a || 'I', 'o': s.best.o || chr(10) || 'assistant:'}} ELSE s.best END) AS best
      FROM s JOIN c ON c.g = s.g AND c.n = s.n WHERE s.state <> 1 GROUP BY s.g)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
    CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(substr(e.best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, {_GROUP} AS g FROM conversations) i LEFT JOIN c ON c.g = i.g LEFT JOIN e ON e.g = i.g""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repair_report(damage(turns), turns)
