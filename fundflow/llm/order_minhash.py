"""Document fingerprints by order MinHash (operator 13); DataFrame functions only.

A text is its sequence of words (runs without \\x20 and \\x09-\\x0D). Its k-mers are all runs of
``words`` consecutive words (the whole sequence, if it is shorter); equal k-mers are told apart by
their occurrence number, so that each (k-mer, occurrence) stands for one place of the text. For
every slot one permutation of those pairs is drawn, the ``tuple_size`` least pairs are selected,
put back into the order they have in the text, and the tuple of their k-mers is hashed. Two texts
agree in a slot if the same k-mers are selected *and* stand in the same order, which falls off with
the edit distance: words moved about change it, unlike with a set of shingles.

The permutations are rotations of one random order: a pair's rank in slot i is (hash - i * 2**64 /
slots) mod 2**64. Each is a random permutation by itself, all are read from one sorted list, and a
short text needs no filling in. Hashes are 64 bits wide; the lowest bits of a sort key hold the
place in the text, as many as the text needs, so no length is too long. Chance agreement of a slot
is 2**-32.

The work for a document is done within its row and is n log n in its words; nothing is exploded and
nothing but the neighbours' texts is shuffled.

Cases: a null text is an empty one; texts without words share one fingerprint and are like each
other (1) and unlike all others (0); equal texts have equal fingerprints; a repeated row is a row
of its own; an empty table gives an empty result; other columns, whatever their names, are left
alone. ``with_next`` puts rows in descending order of ``doc_id`` (nulls last), then of the text's
hash, then of the text; equal rows follow one another in any order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import fresh

#: Words of a k-mer, k-mers of a slot, slots.
WORDS, TUPLE, SLOTS = 2, 2, 128
#: Text of a slice of neighbours, and the most slices (beyond that slices grow).
SLICE_BYTES, MOST_SLICES = 4 << 20, 1 << 18

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def slots(text: Column, words: int = WORDS, tuple_size: int = TUPLE, count: int = SLOTS) -> Column:
    """The hashed tuples of a text, one (of 32 bits) for each slot; zeros for a text without words."""
    anchors = F.array(*[F.lit(i * (2 ** 64 // count) - 2 ** 63) for i in range(count)])
    none = F.array_repeat(F.lit(0), count)

    def of_kmers(kmers: Column, n: Column) -> Column:
        bits = F.length(F.bin(n)).cast("int")
        return let(bits, lambda b: let(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1, lambda low: selected(kmers, n, b, low)))

    def selected(kmers: Column, n: Column, bits: Column, low: Column) -> Column:
        def key(h: Column, place: Column) -> Column:  # places count from 1: an anchor's lowest bits are 0
            return h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(place)

        def pairs(by_kmer: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
                F.call_function("shiftrightunsigned", F.get(by_kmer, i).bitwiseXOR(F.get(by_kmer, i - 1)), bits) != 0))
            numbers = let(starts, lambda s: F.flatten(F.zip_with(
                s, F.slice(s, 2, F.size(s)), lambda a, b: F.sequence(F.lit(0), F.coalesce(b, n) - a - 1))))
            return F.zip_with(by_kmer, numbers, lambda x, o: let(
                x.bitwiseAND(low), lambda place: key(F.xxhash64(F.get(kmers, place.cast("int") - 1), o), place)))

        def tuples(ordered: Column) -> Column:
            size = F.least(n, F.lit(tuple_size))
            at = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.get(ordered, i).bitwiseAND(low) == 0)
            places = F.transform(F.filter(ordered, lambda x: x.bitwiseAND(low) != 0), lambda x: x.bitwiseAND(low).cast("int"))
            return let(F.sequence(F.lit(0), size - 1), lambda picks: let(places, lambda p: F.transform(
                at, lambda x, i: F.hash(F.transform(
                    F.sort_array(F.transform(picks, lambda j: F.get(p, (x - i + j) % n))),
                    lambda place: F.get(kmers, place - 1))))))

        by_kmer = F.sort_array(F.transform(kmers, lambda h, i: key(h, i.cast("long") + 1)))
        return let(let(by_kmer, lambda s: F.sort_array(F.concat(pairs(s), anchors))), tuples)

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w) - (words - 1), F.lit(1))
        kmers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) == 0, none).otherwise(let(n, lambda m: let(kmers, lambda k: of_kmers(k, m))))

    return let(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0)), of_words)


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots in which two fingerprints agree (0 to 1)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def slice_tops(keyed: DataFrame, key: list[str], slices: int) -> list[list]:
    """The greatest key of each slice of a range partitioning, in order; one row a slice comes to the driver."""
    part = F.spark_partition_id().alias("part")
    tops = keyed.select(*key).repartitionByRange(slices, *key).groupBy(part).agg(F.max(F.struct(*key)).alias("top")).collect()
    return sorted([list(r["top"]) for r in tops])


def with_next(docs: DataFrame, values: dict[str, str], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with columns (new name: its source) of the next document in descending order of ``doc_id``.

    After the last document comes the first.
    Rows are dealt to slices of neighbours by their key (doc_id, hash of the text). The slices' bounds come from
    a range partitioning of the keys alone; the texts move once. The first row of each slice is sent to the slice
    before it as well. Copies of one row that would fill slices of their own are dealt anywhere but for one
    slice's worth: each of those is followed by a copy of itself.
    """
    known, number, digest, part, ghost = (fresh(x) for x in ("known", "number", "digest", "slice", "ghost"))
    key = [known, number, digest]
    keyed = docs.withColumns({known: F.col("doc_id").isNotNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
                              digest: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    rows, size = keyed.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    count = max(1, min(MOST_SLICES, -(-(size or 0) // slice_bytes)))
    tops = slice_tops(keyed, key, count)
    each = max(100, -(-rows // count))  # of a crowd about as many copies stay in order: none with odds of e**-100 at most
    crowds = [[*r[:3], int(r["n"])] for r in keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 4 * each).collect()] if count > 1 else []  # at most count / 4 rows

    shape = f"array<struct<{known}: boolean, {number}: bigint, {digest}: bigint>>"

    def literal(rows: list[list]) -> Column:
        return F.from_json(F.lit(json.dumps([dict(zip(key, r)) for r in rows])), shape)

    own = F.struct(*key)
    last = max(0, len(tops) - 1)

    def search(k: Column) -> Column:  # how many slices end before the key
        def step(a: Column, _: Column) -> Column:
            middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            return let(middle, lambda m: F.when(F.get(bounds, m) < k, F.struct((m + 1).alias("lo"), a["hi"].alias("hi")))
                       .otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))
        start = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, last.bit_length() + 1))), start, step, lambda a: F.least(a["lo"], F.lit(last)))

    bounds = literal(tops)
    placed = keyed.withColumn(part, let(own, search))
    rest = None
    if crowds:
        crowd, spread = fresh("crowd"), fresh("spread")
        thrown = placed.withColumns({crowd: F.array_position(literal([c[:3] for c in crowds]), own), spread: F.rand(7)})
        stays = F.get(F.array(*[F.lit(each / c[3]) for c in crowds]), F.col(crowd).cast("int") - 1)
        thrown = thrown.withColumn(crowd, (F.col(crowd) > 0) & (F.col(spread) >= stays))
        rest = thrown.where(F.col(crowd)).withColumns({new: F.col(c) for new, c in values.items()}).select(*docs.columns, *values)
        placed = thrown.where(~F.col(crowd)).drop(crowd, spread)
    copies = F.when(own == F.get(bounds, F.col(part)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    ghosts = placed.withColumn(ghost, F.explode(copies)).withColumn(
        part, F.when(F.col(ghost), (F.col(part) + 1) % F.lit(last + 1)).otherwise(F.col(part)))
    order = Window.partitionBy(part).orderBy(ghost, F.desc(known), F.desc(number), F.desc(digest), F.desc("text"))
    following = {new: F.lead(c).over(order) for new, c in values.items()}
    found = ghosts.withColumns(following).where(~F.col(ghost)).select(*docs.columns, *values)
    return found.unionByName(rest) if rest is not None else found
