"""One query per operator over its whole table, and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import chat, decontaminate, html, language, minhash, mixing, multiset, pii, repair, simhash, spelling, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage, with its SQL where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


@query("op1_minhash_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(d, x) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.d, l.b FROM r JOIN l ON r.x = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT d, min(x) AS c FROM r GROUP BY d) m ON n.doc_id = m.d""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_chat_formatting", """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
  FROM conversations),
p AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place) AS r
  FROM t),
e AS (SELECT r, n, min(conv_id) AS conv_id FROM p WHERE place = n GROUP BY r, n)
SELECT conv_id, n AS n_turns, length(r)::BIGINT AS n_chars, r AS rendered FROM e
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.r = e.r AND p.place = e.n)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return chat.maximal_conversations(read(spark, sf_dir, "conversations"))


@query("op4_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS wide FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
bw AS (SELECT item_id, wide, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM b),
h AS (
  SELECT doc_id, item_id, dw.p - bw.p AS shift FROM dw JOIN bw USING (w)
  GROUP BY doc_id, item_id, dw.p - bw.p, wide HAVING count(*) * 100 >= wide * {decontaminate.PERCENT}),
f AS (
  SELECT DISTINCT doc_id, item_id FROM h JOIN b USING (item_id) JOIN d USING (doc_id)
  WHERE len(list_filter(
    range(greatest(shift + 1, 1), least(shift + len(b.ws), len(d.ws)) - wide + 2),
    lambda j: len(list_filter(range(j, j + wide), lambda p: d.ws[p] = b.ws[p - shift])) * 100 >= wide * {decontaminate.PERCENT})) > 0),
g AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM f GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_items, ids AS item_ids, TRUE AS contaminated FROM d JOIN g USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the items; all documents are searched."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).where("contaminated")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long repeats cut out of all documents."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents"))


@query("op8_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS h, min(page_id) OVER (PARTITION BY sha256(body)) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id != f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id != f THEN f END AS refers_to FROM d""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return multiset.fingerprints(read(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.identify(read(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(read(spark, sf_dir, "documents")).drop("text_id")


@query("op9_mixing_sources")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all documents takes."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


@query("op3_html_extraction", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
a AS (SELECT page_id, url, regexp_extract(h, '<article>(.*?)(</article>|$)', 1, 's') AS h FROM p),
b AS (SELECT page_id, url, regexp_split_to_array(h, '</?(h1|p)>') AS parts FROM a),
t AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '</?(b|br)>', ' ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g'))), lambda x: x != '') AS ls
  FROM b)
SELECT page_id, url, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS text,
  length(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'))::BIGINT AS n_chars FROM t""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(read(spark, sf_dir, "pages"))


def crc32_sql(codes: str) -> str:
    """CRC-32 (reflected, as zlib's) of the text with these code points, all at most U+00FF, in UTF-8, bit by bit."""
    bytes_ = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END))"
    bits = f"flatten(list_transform({bytes_}, lambda v: list_transform(range(0, 8), lambda k: (v::BIGINT >> k::INT) & 1)))"
    step = "lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


CODES_SQL = "list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"


@query("op13_spelling_variants", f"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT run, n, {crc32_sql(CODES_SQL.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM r),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, k, substr(word, 1, k::INT - 1) || substr(word, k::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM x a JOIN x b ON a.rest = b.rest AND a.k = b.k AND a.word != b.word
  UNION SELECT a.word, b.word FROM x a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word FROM x a JOIN w b ON a.rest = b.word),
f AS (
  SELECT a AS word, count(*) AS n_near, min(row(-w.n, encode(b), b)) AS best FROM p JOIN w ON w.word = p.b GROUP BY a),
g AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[3] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
  FROM w LEFT JOIN f USING (word)),
c(word, reached, onward) AS (SELECT word, word, form FROM g UNION ALL SELECT c.word, g.word, g.form FROM c JOIN g ON g.word = c.onward)
SELECT g.word, g.form, c.reached AS root, g.n, g.n_near::BIGINT AS n_near, g.form_n::BIGINT AS form_n FROM g JOIN c ON c.word = g.word AND c.onward IS NULL""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


@query("op12_simhash_near_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def _edit_sql(paid: str, letter: str, line: str, state: str) -> str:
    return f"{{'c': {paid} + {state}.c, 'a': '{letter}' || {state}.a, 't': {line}{state}.t}}"


def _state_sql(q: int, kept: dict[str, int]) -> str:
    """Cheapest way on from a row in state `q`: delete it, or keep or rerole it where that may be."""
    made = 3 if q == 2 else 2
    ways = [f"[{_edit_sql('3', 'D', '', f'r.s{q}')}]", f"CASE WHEN forced THEN [] ELSE [{_edit_sql('2 + cut', 'R', f"""['{'assistant' if made == 3 else 'user'}:' || text] || """, f'r.s{made}')}] END"]
    ways += [f"CASE WHEN forced OR initial != '{c}' THEN [] ELSE [{_edit_sql('cut', 'K', "[role || ':' || text] || ", f'r.s{to}')}] END" for c, to in kept.items()]
    return f"list_min({' || '.join(ways)})"


@query("op11_conversation_repair", f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql(CODES_SQL.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS k
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE k != 0),
p AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS empty,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place
  FROM d),
f AS (
  SELECT *, empty OR seen AS forced, NOT empty AND seen AS again,
    (NOT empty AND NOT seen AND regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?'))::BIGINT AS cut,
    place > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS odd
  FROM p),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(empty::INT)::BIGINT AS blank, sum(again::INT)::BIGINT AS duplicate,
    sum(cut)::BIGINT AS truncated, sum(odd::INT)::BIGINT AS illegal, max(place) AS n
  FROM f GROUP BY conv_id),
r(conv_id, place, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}},
    {{'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']}}, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} FROM s
  UNION ALL
  SELECT conv_id, place, list_min([b0, {_edit_sql('2', 'I', "['user:'] || ", 'm2')}]), list_min([b1, {_edit_sql('2', 'I', "['user:'] || ", 'm2')}]), m2,
    list_min([b3, {_edit_sql('2', 'I', "['user:'] || ", 'b2')}])
  FROM (
    SELECT *, list_min([b2, {_edit_sql('2', 'I', "['assistant:'] || ", 'b3')}]) AS m2 FROM (
      SELECT r.conv_id, r.place - 1 AS place, {_state_sql(0, {'s': 1, 'u': 2})} AS b0, {_state_sql(1, {'u': 2})} AS b1, {_state_sql(2, {'a': 3})} AS b2, {_state_sql(3, {'u': 2})} AS b3
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.place = r.place) AS x) AS y)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(r.s0.c, 0) AS cost, coalesce(r.s0.a, '') AS audit, sha256(coalesce(array_to_string(r.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN r ON r.place = 0 AND r.conv_id IS NOT DISTINCT FROM i.conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    return repair.repair(repair.damaged(read(spark, sf_dir, "conversations")))
