"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import ann, decontamination, lines, leaderboard, lm, merkle, mixing, secrets, sharding, simhash, suffixes, toxicity, windows
from foliant.llm import pipeline as corpus
from foliant.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_copies", "mix_copy", "mix_key", F.md5("text").alias("text_md5"))  # of the text as shuffled


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, lower = F.col("text"), F.translate("text", lines.UPPER, lines.LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(text)
    out = merkle.manifest(table(spark, sf_dir, "documents"), columns=["doc_id", "source", "lang", "n_chars", "text"], now={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.changes(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"), table(spark, sf_dir, "vendors"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = windows.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_ann, op3_secrets, op4_simhash, op5_decontamination, op6_sharding, op7_toxicity, op8_line_dedup, op9_lm_scoring, op10_suffix_dedup, op11_merkle, op12_leaderboard, op13_substrings, pipeline)}


OP1_SQL = """
WITH sized AS (SELECT source, CAST(SUM(COALESCE(strlen(text), 0)) AS DOUBLE) AS bytes FROM documents GROUP BY source),
rated AS (
  SELECT source, CASE WHEN bytes > 0 THEN SUM(bytes) OVER () / COUNT(CASE WHEN bytes > 0 THEN 1 END) OVER () / bytes ELSE 0 END AS rate FROM sized
),
terms AS (
  SELECT source, rate, k, SUM(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k) - rate AS log_p
  FROM rated, range(0, 2000) AS r(k) WHERE rate > 0 AND k <= CAST(ceil(rate + 10 * sqrt(rate) + 40) AS INT)
),
cdf AS (SELECT source, k, SUM(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM terms),
drawn AS (SELECT doc_id, source, md5(text) AS text_md5, ('0x' || substr(md5('0|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text_md5, (SELECT COUNT(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u) AS n FROM drawn d)
SELECT doc_id, source, CAST(n AS INT) AS mix_copies, CAST(c AS INT) AS mix_copy,
       ('0x' || substr(md5('order0|' || doc_id || '|' || c), 1, 13))::BIGINT AS mix_key, text_md5
FROM (SELECT doc_id, source, text_md5, n, unnest(range(1, n + 1)) AS c FROM counted)
"""

OP5_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + least(13, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM item WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
found AS (
  SELECT pos.doc_id, pos.p, win.item_id, len(win.win) AS n FROM pos JOIN win ON pos.w[pos.p] = win.win[1]
  WHERE list_slice(pos.w, pos.p, pos.p + len(win.win) - 1) = win.win
),
hit AS (SELECT doc_id, COUNT(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(doc.w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8_SQL = r"""
WITH line AS (
  SELECT doc_id, k, x, translate(trim(x, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(COALESCE(text, ''), E'\n')) AS x, generate_subscripts(string_split(COALESCE(text, ''), E'\n'), 1) AS k FROM documents)
),
often AS (SELECT key, MAX(doc_id) AS last FROM line WHERE length(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
marked AS (SELECT line.*, often.key IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN often ON line.key = often.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(COALESCE(string_agg(x, E'\n' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: CRC-32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({s}) + 1), lambda k: ascii(({s})[k])::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


def _encoded(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


_LEAF = "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, h, claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM (
    SELECT doc_id, lang, {_LEAF.format(text="text")} AS h, CASE WHEN {CRC32.format(s="doc_id::VARCHAR")} % 3 = 0
      THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format(text="text")} END AS claimed
    FROM documents)
),
node(l, lang, i, h) AS (
  SELECT 0, lang, i, h FROM leaves
  UNION ALL
  SELECT l + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM node) WHERE c > 1 GROUP BY l, lang, i // 8
),
sub AS (SELECT lang, max(l) AS l, arg_max(h, l) AS h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM node GROUP BY lang),
top(l, i, h) AS (
  SELECT 0, i, h FROM sub
  UNION ALL
  SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM top) WHERE c > 1 GROUP BY l, i // 8
),
side AS (
  SELECT a.lang, a.l, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM node a JOIN node b ON a.lang IS NOT DISTINCT FROM b.lang AND a.l = b.l AND a.i // 8 = b.i // 8 JOIN sub ON sub.lang IS NOT DISTINCT FROM a.lang AND a.l < sub.l GROUP BY a.lang, a.l, a.i
),
top_side AS (
  SELECT a.l, a.i, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, COALESCE(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM top a JOIN top b ON a.l = b.l AND a.i // 8 = b.i // 8 WHERE a.l < (SELECT max(l) FROM top) GROUP BY a.l, a.i
),
up(doc_id, lang, leaf, l, i, h, proof) AS (
  SELECT doc_id, lang, h, 0, i, claimed, '' FROM leaves
  UNION ALL
  SELECT u.doc_id, u.lang, u.leaf, u.l + 1, u.i // 8, sha256(s.before || u.h || s.after), u.proof || s.before || s.after FROM up u JOIN side s ON s.lang IS NOT DISTINCT FROM u.lang AND s.l = u.l AND s.i = u.i
),
done AS (SELECT up.*, sub.h AS subroot, sub.i AS place FROM up JOIN sub ON sub.lang IS NOT DISTINCT FROM up.lang AND sub.l = up.l),
over(doc_id, leaf, subroot, l, i, h, proof) AS (
  SELECT doc_id, leaf, subroot, 0, place, h, proof FROM done
  UNION ALL
  SELECT o.doc_id, o.leaf, o.subroot, o.l + 1, o.i // 8, sha256(s.before || o.h || s.after), o.proof || s.before || s.after FROM over o JOIN top_side s ON s.l = o.l AND s.i = o.i
),
root AS (SELECT l, h FROM top ORDER BY l DESC LIMIT 1)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, over.h AS folded_root, over.h = root.h AS verified FROM over JOIN root ON over.l = root.l
"""

OP12_SQL = f"""
WITH line AS (
  SELECT l.*, v.nation_id, i.item_id AS found, i.price,
         {CRC32.format(s="concat(COALESCE(sale_id::VARCHAR, ''), ',', COALESCE(l.item_id::VARCHAR, ''), ',', COALESCE(l.vendor_id::VARCHAR, ''), ',', COALESCE(line_no::VARCHAR, ''))")} AS h
  FROM sale_lines l LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN items i ON i.item_id = l.item_id
),
dated AS (SELECT *, COALESCE(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) AS s FROM line),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
batched AS (SELECT *, greatest(1, least(8, 1 + CAST(floor((a - 19723) * 8 / 180) AS BIGINT))) AS batch FROM arrived),
latest AS (SELECT b.batch, (SELECT max(s) FROM batched x WHERE x.batch < b.batch) AS floor_s FROM (SELECT DISTINCT batch FROM batched) b),
delta AS (
  SELECT nation_id, found AS item_id, a, batch, CAST(sum(COALESCE(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) * CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END) AS BIGINT) AS cents
  FROM batched JOIN latest USING (batch) WHERE nation_id IS NOT NULL AND found IS NOT NULL AND (floor_s IS NULL OR s + 15 >= floor_s) GROUP BY ALL
),
run AS (
  SELECT nation_id, item_id, a, CAST(sum(cents) OVER w AS BIGINT) AS revenue, lead(a) OVER w AS until FROM delta WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)
),
day AS (SELECT nation_id, a, batch, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS k FROM (SELECT DISTINCT nation_id, a, batch FROM delta)),
held AS (SELECT d.nation_id, d.k, d.a, d.batch, r.item_id, r.revenue FROM day d JOIN run r ON r.nation_id = d.nation_id AND r.a <= d.a AND (r.until IS NULL OR d.a < r.until)),
board AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nation_id, k ORDER BY revenue DESC, item_id) AS rank FROM held WHERE revenue > 0) WHERE rank <= 10),
pairs AS (
  SELECT COALESCE(n.nation_id, o.nation_id) AS nation_id, COALESCE(n.k, o.k + 1) AS k, COALESCE(n.item_id, o.item_id) AS item_id, o.rank AS old_rank, n.rank AS new_rank
  FROM board n FULL JOIN board o ON n.nation_id = o.nation_id AND n.k = o.k + 1 AND n.item_id = o.item_id
)
SELECT pairs.nation_id, CAST(held.a AS BIGINT) AS arrival_day, pairs.item_id, CAST(held.batch AS INT) AS batch,
       CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, CAST(old_rank AS INT) AS old_rank, CAST(new_rank AS INT) AS new_rank, held.revenue
FROM pairs JOIN held ON held.nation_id = pairs.nation_id AND held.k = pairs.k AND held.item_id = pairs.item_id WHERE old_rank IS DISTINCT FROM new_rank
"""

OP13_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (SELECT r, k, array_to_string(list_slice(w, k, k + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM doc WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS x FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
word AS (SELECT r, x, w[x] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS x FROM doc)),
left_ AS (SELECT r, string_agg(word, ' ' ORDER BY x) AS kept FROM word ANTI JOIN gone USING (r, x) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_ USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)
"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_mixing": OP1_SQL, "op5_decontamination": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_merkle": OP11_SQL, "op12_leaderboard": OP12_SQL, "op13_substrings": OP13_SQL}
    return out | ({"pipeline": corpus.ORACLE_SQL} if corpus.ORACLE_SQL else {})
