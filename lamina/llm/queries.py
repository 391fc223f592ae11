"""The registered queries of this package, one per operator, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import byte_bpe, line_dedup, lm_score, near_dup, order_minhash, packing, periodic_runs, quality, sentencepiece, token_files, toxicity, turn_repair, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    """``decoded_sha256`` is of the text that decoding gives back."""
    encoded = sentencepiece.encode_pieces(table(spark, sf_dir, "documents"))
    decoded = sentencepiece.decode_pieces(encoded)
    return decoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op1_near_dup")
def op1_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


#: The visible lines of a page are found by the same patterns in both engines.
_PAGE_LINES = """
    SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
           list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
               '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
    FROM pages"""


@query("op10_line_dedup", f"""
WITH p AS ({_PAGE_LINES}),
  l AS (SELECT page_id, host, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM p),
  c AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l WHERE NOT regexp_matches(line, '^[\x20\x09-\x0D]*$') GROUP BY ALL),
  t AS (SELECT host, count(*) AS total FROM p GROUP BY ALL),
  b AS (SELECT c.host, c.line FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE c.n > 0.1 * t.total AND c.n >= 3),
  k AS (SELECT l.page_id, list(l.line ORDER BY k) AS kept FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line WHERE b.line IS NULL GROUP BY ALL),
  f AS (SELECT p.page_id, p.host, p.lines, CASE WHEN 2 * length(coalesce(array_to_string(k.kept, ''), '')) >= length(array_to_string(p.lines, '')) THEN coalesce(k.kept, []) ELSE p.lines END AS kept
        FROM p LEFT JOIN k USING (page_id))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM f""")
def op10_line_dedup(spark, sf_dir):
    return line_dedup.dedup_pages(table(spark, sf_dir, "pages"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Base32 from the 160 bits of a SHA-1: five at a time.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
    CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 16 >> j ELSE 0 END))::BIGINT, 1)), '')"""


@query("op9_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, h, array_to_string(list_transform(range(40), lambda i: substr(
          '0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(sha1(h), i + 1, 1)) - 1) + 1, 4)), '') AS bits FROM p),
  f AS (SELECT page_id, h, bits, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""")
def op9_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest, with_html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    return lm_score.scores(table(spark, sf_dir, "documents"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark, sf_dir):
    decoded = byte_bpe.decode_bytes(byte_bpe.encode_bytes(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _more(state: str, cost: str, letter: str) -> str:
    """A state (cost in six digits, then the audit) after one more edit."""
    return f"(lpad(CAST(CAST(left({state}, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || {letter})"


_STAYS = "CASE WHEN x[2] = 't' THEN 1 ELSE 0 END"


def _edited(states: list[str], role: str) -> str:
    """The least of keeping a row with this role, or giving it to it, after one of ``states``."""
    ways = ", ".join(_more(s, f"(CASE WHEN x[1] = '{role}' THEN 0 ELSE 2 END + {_STAYS})", f"CASE WHEN x[1] = '{role}' THEN 'K' ELSE 'R' END") for s in states)
    return f"CASE WHEN x[2] IN ('b', 'd') THEN NULL ELSE least({ways}, NULL) END"


#: The cheapest edits row by row; states: nothing yet, after s, after u, after a.
_REPAIR_STEP = f"""list_transform([[{_more('acc[1]', '3', "'D'")}, least({_more('acc[2]', '3', "'D'")}, CASE WHEN x[1] = 's' AND x[2] NOT IN ('b', 'd') THEN {_more('acc[1]', _STAYS, "'K'")} END),
     least({_more('acc[3]', '3', "'D'")}, {_edited(['acc[1]', 'acc[2]', 'acc[4]'], 'u')}), least({_more('acc[4]', '3', "'D'")}, {_edited(['acc[3]'], 'a')})]],
   lambda n: list_transform([[n[1], n[2], least(n[3], {_more('n[1]', '2', "'I'")}, {_more('n[2]', '2', "'I'")}, {_more('n[4]', '2', "'I'")}), n[4]]],
     lambda m: [m[1], m[2], m[3], least(m[4], {_more('m[3]', '2', "'I'")})])[1])[1]"""


@query("op12_turn_repair", f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
  c1 AS (SELECT c0.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(k)), lambda i: CAST(unicode(substr(k, i + 1, 1)) AS BIGINT))),
     lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 20 AS kind FROM c0, tab),
  c2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
     unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c1 WHERE kind <> 0),
  c3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM c2),
  c4 AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM c3),
  g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
     count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal, list([ini, fault] ORDER BY place) AS l FROM c4 GROUP BY conv_id),
  r AS (SELECT * EXCLUDE (l), list_reduce(list_prepend(['000000', NULL, '000002I', '000004II'], l), lambda acc, x: {_REPAIR_STEP}) AS s FROM g),
  e AS (SELECT *, substr(least(s[1], s[4]), 7) AS audit, CAST(left(least(s[1], s[4]), 6) AS BIGINT) AS cost FROM r),
  u AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM e),
  v AS (SELECT conv_id, i, substr(audit, i, 1) AS edit, length(replace(left(audit, i), 'I', '')) AS place, length(replace(left(audit, i), 'D', '')) - 1 AS n FROM u),
  w AS (SELECT v.conv_id, v.i, v.edit, v.n, c4.role, c4.text, c4.ini FROM v LEFT JOIN c4 ON c4.conv_id IS NOT DISTINCT FROM v.conv_id AND c4.place = v.place WHERE edit <> 'D'),
  y AS (SELECT *, max(CASE WHEN n = 0 AND edit = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM w),
  z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h FROM y GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op12_turn_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.summarised(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))
