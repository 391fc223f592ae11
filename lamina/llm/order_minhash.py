"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers are runs of three words (words of more than 16 characters count
as several). Each occurrence is numbered, (k-mer, 0), (k-mer, 1), and hashed, so
that repeated k-mers stay apart. For each of the 64 entries the two occurrences
with least hashes are selected, put back in text order, and the pair of k-mers
is hashed: two texts agree in an entry when they share k-mers in the same order.

The 64 orders come from one hash: its leading 6 bits deal occurrences to bins,
and the order of entry j takes bin j first, then the bins after it, each by
hash. All are found in a single sorted array, so the work is n log n whatever
the number of entries.

A null or empty text, or one of white space, has the fingerprint of no words.
Equal texts have equal fingerprints. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import let, stored
from lamina.operators.ranking import ranked

K, BITS = 3, 6
ENTRIES = 1 << BITS
_TOKEN, _CHARACTER = r"[^\x20\x09-\x0D]{1,16}", r"[^\x20\x09-\x0D]"
#: Texts of fewer code points than this are too few words for pairs of k-mers; their k-mers are of characters.
SHORT = 96
#: The leading 33 bits hold the hash, the other 31 the place in the text.
_HIGH, _PLACE = -(1 << 31), (1 << 31) - 1


def _places(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _numbered(kmers: Column) -> Column:
    """Hashes of numbered occurrences with their places, ascending by hash."""
    def count(p: Column) -> Column:
        high = lambda j: F.get(p, j).bitwiseAND(F.lit(_HIGH))
        value = lambda x, occurrence: F.xxhash64(x.bitwiseAND(F.lit(_HIGH)), occurrence).bitwiseAND(F.lit(_HIGH)).bitwiseOR(x.bitwiseAND(F.lit(_PLACE)))
        firsts = F.filter(_places(F.size(p)), lambda j: (j == 0) | (high(j) != high(j - 1)))

        def by_run(starts: Column) -> Column:
            runs = F.transform(starts, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(starts, r + 1), F.size(p)) - 1), lambda j: value(F.get(p, j), j - a)))
            return F.when(F.size(starts) == F.size(p), F.transform(p, lambda x: value(x, F.lit(0)))).otherwise(F.flatten(runs))

        return let(firsts, by_run)

    packed = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))))
    return F.sort_array(let(packed, count))


def _entries(kmers: Column, s: Column) -> Column:
    bin_of = lambda v: (F.shiftright(v, 64 - BITS) + ENTRIES // 2).cast("int")

    def cover(firsts: Column) -> Column:
        """For each entry the place in ``s`` where its order begins: the first occurrence in its bin or the next that has any."""
        reach = F.transform(firsts, lambda j, r: F.array_repeat(j, bin_of(F.get(s, j)) - F.coalesce(bin_of(F.get(s, F.get(firsts, r - 1))), F.lit(-1))))
        return F.concat(F.flatten(reach), F.array_repeat(F.lit(0), ENTRIES - 1 - bin_of(F.element_at(s, -1))))

    firsts = F.filter(_places(F.size(s)), lambda j: (j == 0) | (bin_of(F.get(s, j)) != bin_of(F.get(s, j - 1))))

    def entry(j: Column, e: Column) -> Column:
        a, b = F.get(s, j).bitwiseAND(F.lit(_PLACE)).cast("int"), F.get(s, (j + 1) % F.size(s)).bitwiseAND(F.lit(_PLACE)).cast("int")
        return F.xxhash64(e, F.get(kmers, F.least(a, b)), F.get(kmers, F.greatest(a, b))).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.transform(let(firsts, cover), entry)


def fingerprint(text: Column) -> Column:
    """64 entries of 32 bits, as an array of long."""
    text = F.coalesce(text, F.lit(""))
    words = F.when(F.length(text) < SHORT, F.regexp_extract_all(text, F.lit(_CHARACTER), 0)).otherwise(F.regexp_extract_all(text, F.lit(_TOKEN), 0))
    kmers = let(words, lambda w: F.when(F.size(w) < K, F.array(F.xxhash64(w))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - K + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, K)))))
    return let(kmers, lambda k: let(_numbered(k), lambda s: _entries(k, s)))


def as_string(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(ENTRIES))


def followers(docs: DataFrame) -> DataFrame:
    """Each distinct ``doc_id`` with the next in descending order, the last with the first; null counts as the least."""
    ids = docs.select("doc_id").distinct()
    r = stored(ranked(ids, [F.col("doc_id").desc_nulls_last()], "r", start=0), "ranks")
    n = r.count()
    after = r.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("r") - 1, F.lit(max(n, 1))).alias("r"))
    return r.join(after, "r").select("doc_id", "next_id")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (the last third replaced by
    the start of the next document's) and how alike they and the next one's are.
    Each text is shuffled once; the next document sends only the characters needed.
    Rows that repeat a doc_id each give a row; as next document the least of their texts counts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = d.groupBy("doc_id").agg(F.max(F.expr("char_length(text) div 3")).cast("int").alias("need"))
    pairs = followers(d).select(F.col("doc_id").alias("target"), "next_id")
    asked = lengths.join(pairs, F.col("doc_id").eqNullSafe(F.col("target"))).select("target", "need", "next_id")
    givers = d.join(asked, F.col("doc_id").eqNullSafe(F.col("next_id"))).select(
        "target", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("given"), fingerprint(F.col("text")).alias("next_fp")).alias("g"))
    given = givers.groupBy("target").agg(F.min("g").alias("g"))
    n, third = F.length("text"), F.expr("char_length(text) div 3")
    both = d.join(given, F.col("doc_id").eqNullSafe(F.col("target"))).select(
        "doc_id", n.cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fp"), F.col("g.next_fp").alias("next_fp"),
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("g.given", F.lit(1), third)).alias("edited"))
    done = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return done.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
