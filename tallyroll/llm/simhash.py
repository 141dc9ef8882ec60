"""SimHash fingerprints of whole texts, and search within a Hamming radius by permuted block tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import dense_ordinal
from ..session import written

_BITS = 128
_BLOCKS = 8  # of 16 bits
_PAIR_MASK = (1 << 32) | 1


def term_weight(term: Column) -> Column:
    """1 to 8 by length: short words are common in every language; needs no corpus, so prints stay comparable."""
    return F.least(F.lit(8), F.greatest(F.lit(1), F.length(term) - 2)).cast("long")


def votes(texts: DataFrame, *keys: str) -> DataFrame:
    """Fingerprint halves ``hi`` and ``lo`` of ``text`` for each group of ``keys``.

    Terms are lower-cased runs of letters and digits with their repetitions. A
    term's weight votes for or against each of the 128 bits of its hash. One long sum
    holds the votes for two bits, 32 bits apart and in 32-bit fields (good for
    500 million terms a text); votes against follow from the total.
    """
    terms = texts.select(*keys, F.explode_outer(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term"))
    weight = F.when(F.length("term") > 0, term_weight(F.col("term"))).otherwise(F.lit(0))
    hashed = terms.select(
        *keys, weight.cast("long").alias("w"), F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"))
    sums = [
        F.sum(F.shiftrightunsigned(f"h{h}", j).bitwiseAND(F.lit(_PAIR_MASK)) * F.col("w")).alias(f"s{h}_{j}")
        for h in (0, 1) for j in range(32)
    ]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def half(h: int) -> Column:
        bits = []
        for j in range(32):
            s = F.col(f"s{h}_{j}")
            for ones, bit in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(s, 32), j + 32)):
                value = 1 << bit if bit < 63 else -(1 << 63)
                bits.append(F.when(2 * ones > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return summed.select(*keys, half(0).alias("hi"), half(1).alias("lo"))


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(distance: Column) -> Column:
    """Cosine that the share of differing bits stands for; 0 for unrelated and opposed prints."""
    return F.greatest(F.lit(0.0), F.cos(distance * F.lit(3.141592653589793 / _BITS)))


def print_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _block(i: int, hi: str | Column, lo: str | Column) -> Column:
    half = hi if i < 4 else lo
    return F.shiftrightunsigned(half, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 6) -> DataFrame:
    """(qhi, qlo, hi, lo, distance) for every print of ``prints`` within ``radius`` of one of ``queries``.

    Both hold distinct ``hi, lo``. Prints are cut into 8 blocks, and at most 6 differing
    bits leave two blocks alike. Each of the 28 tables brings another two blocks to
    the front as its key. A pair is taken from one table only, that of its first two
    equal blocks, so no pair is met twice. The tables are never broadcast: Spark sizes
    them as if each print still were one row.
    """
    if radius > _BLOCKS - 2:
        raise ValueError(f"the tables are complete up to radius {_BLOCKS - 2}")

    def tables(df: DataFrame, hi: str, lo: str) -> DataFrame:
        entries = [
            F.struct(F.lit((1 << i) | (1 << j)).alias("t"),
                     (F.shiftleft(_block(i, hi, lo), 16).bitwiseOR(_block(j, hi, lo))).alias("front"))
            for i, j in combinations(range(_BLOCKS), 2)
        ]
        return df.withColumn("_e", F.explode(F.array(*entries))).select("*", "_e.t", "_e.front").drop("_e")

    q = queries.select(F.col("hi").alias("qhi"), F.col("lo").alias("qlo"))
    xhi, xlo = F.col("hi").bitwiseXOR(F.col("qhi")), F.col("lo").bitwiseXOR(F.col("qlo"))
    equal = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(_block(i, xhi, xlo) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(_BLOCKS)])
    rest = equal.bitwiseAND(equal - 1)
    first_two = (equal - rest) + (rest - rest.bitwiseAND(rest - 1))
    distance = hamming((F.col("hi"), F.col("lo")), (F.col("qhi"), F.col("qlo")))
    met = tables(prints.select("hi", "lo"), "hi", "lo").join(
        tables(q, "qhi", "qlo").withColumnsRenamed({"t": "qt", "front": "qfront"}).hint("merge"),
        (F.col("t") == F.col("qt")) & (F.col("front") == F.col("qfront")) & (distance <= radius) & (first_two == F.col("t")))
    return met.select("qhi", "qlo", "hi", "lo", distance.alias("distance"))


def fingerprint_documents(
    docs: DataFrame, *, radius: int = 6, query_every: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Prints of every text and of its edited text, and what is near.

    The edited text ends in the beginning of the next document by ascending id, for
    half of the code points (after the last comes the first). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id
    (least id of equal prints), n_within: for ids divisible by ``query_every``, how many other
    rows have a print within ``radius``, and near_classes, for the same ids: distance, class_id and
    fingerprint of every print within ``radius``, the own one too, nearest first. Members of
    a class are the rows with its fingerprint; `near_pairs` gives the list as a table.

    Null texts are empty; a text without terms has the print 0. Ties of id are
    ordered by hash of the text. Rows that repeat id and text count as one document
    when the next is sought, and each returns. Null ids come first; they are no queries. An
    empty table gives no rows. Other columns are ignored. Rows are told apart by a 64-bit hash of
    id and text. Only ids, sizes and the borrowed beginnings move besides one shuffle of the texts.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    narrow = base.select("key", "doc_id", F.length("text").cast("long").alias("n_chars")).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = written(
        dense_ordinal(narrow, F.col("doc_id").asc_nulls_first(), "key", name="place", unique=True), "order")
    rows = order.count()
    following = order.select(F.col("key").alias("next_key"), F.pmod(F.col("place") - 1, F.lit(max(rows, 1))).alias("place"))
    chain = written(order.join(following, "place"), "chain")  # a row for each document: its own and the next one's key
    texts = base.select("key", "text").repartition("key").dropDuplicates(["key"])
    lent = texts.join(chain.select(
        F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("lend")), "key").select(
        F.col("to").alias("key"), F.substring("text", F.lit(1), F.col("lend")).alias("head"), "lend")
    kept = F.substring("text", F.lit(1), (F.length("text") - F.col("lend")).cast("int"))
    both = texts.join(lent, "key").select("key", "text", F.concat(kept, F.col("head")).alias("edited"))
    each = both.select("key", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("e")
    ).select("key", "e.kind", "e.text")

    def of(kind: int, half: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(half)))

    prints = votes(each, "key", "kind").groupBy("key").agg(
        of(0, "hi").alias("hi"), of(0, "lo").alias("lo"), of(1, "hi").alias("ehi"), of(1, "lo").alias("elo"))
    digests = both.select("key", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    known = written(prints.join(digests, "key").join(chain, "key"), "prints")

    classes = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("members"))
    classes = written(classes, "print-classes")
    asked = known.filter(F.pmod(F.col("doc_id").cast("long"), F.lit(query_every)) == 0).select("hi", "lo").distinct()
    met = F.struct("distance", "class_id", print_text(F.col("hi"), F.col("lo")).alias("fingerprint"))
    near = within_radius(classes, asked, radius).join(classes, ["hi", "lo"]).groupBy("qhi", "qlo").agg(
        F.sum("members").alias("within"), F.sort_array(F.collect_list(met)).alias("met")).withColumnsRenamed({"qhi": "hi", "qlo": "lo"})
    after = known.select(F.col("key").alias("next_key"), F.col("hi").alias("nhi"), F.col("lo").alias("nlo"))
    whole = known.join(after, "next_key").join(classes.drop("members"), ["hi", "lo"]).join(near, ["hi", "lo"], "left")
    own = (F.col("hi"), F.col("lo"))
    asks = F.pmod(F.col("doc_id").cast("long"), F.lit(query_every)) == 0
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_chars", "edited_sha256", print_text(*own).alias("fingerprint"),
        print_text(F.col("ehi"), F.col("elo")).alias("edited_fingerprint"),
        likeness(hamming(own, (F.col("ehi"), F.col("elo")))).alias("near_edited"),
        likeness(hamming(own, (F.col("nhi"), F.col("nlo")))).alias("near_next"),
        "class_id", F.when(asks, F.col("within") - 1).alias("n_within"), F.when(asks, F.col("met")).alias("near_classes"))


def near_pairs(found: DataFrame) -> DataFrame:
    """(doc_id, distance, class_id, fingerprint): a row for each query of `fingerprint_documents` and print within its radius."""
    return found.select("doc_id", F.inline("near_classes"))
