"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, union-find; DataFrame functions only.

A line is compared by its normal form (lower case, runs of white space one blank, trimmed). Its shingles are the ``width``
characters from every position (a shorter line is its own shingle). Characters are UTF-16 units, so that a shingle is a
slice at a fixed offset; outside the basic plane a sign is two of them. A line's signature is BANDS x ROWS minima over the
64-bit hashes of its shingles. Lines that agree in all ROWS of a band meet in a bucket.

First each line of a bucket is paired with the bucket's lead. Lines that this does not link to one and the same line are
paired with each other in buckets of up to CROWD lines; the lines of larger ones are dealt again by their other bands. What
is crowded even then is dealt by minima over the shingles that the lead does not have: lines that are alike without being
like the lead must share some of those. This repeats until no bucket is crowded. It ends, as the leads' shingles are gone
from the next round, and no pair is dropped for the size of its bucket. Candidates of which half of the minima agree are
verified by the exact Jaccard similarity of their whole sets of shingles (as 64-bit hashes, made where the pair is); verified links are joined into
components, and of each component one line stays: the first by (doc_id, row, position).

Equal normal forms are one key (a 64-bit hash) throughout, so copies of a line cost one row each and are never paired.

Defined cases: blank lines are no lines of text and always stay; a null text stays null; an empty text stays empty; rows of
one document id with different texts are different documents, told apart by a hash of the text, and equal rows lose the same
lines; rows without an id keep all lines; an empty table gives no rows; extra columns, whatever their names, are kept by
``dedup_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsheet.llm.common import drop, hot_join, materialise
from finsheet.llm.components import connected_components

BANDS, ROWS = 8, 3
MINIMA = BANDS * ROWS
#: Lines of a bucket up to which all its pairs are candidates.
CROWD = 12
#: Minima over a line's shingles outside the lead, each a bucket of its own.
DEEPER = 20
#: The same from the second round on: what the first one left crowded meets under several leads, so in more than one bucket anyway.
DEEPEST = 8
#: Pairs of one line in a task.
SHARE = 1000
#: Keys or buckets up to which they are sent to every task (some 20 MB); more are joined.
SENT = 500_000


def _normal(line):
    """Lower case, runs of white space one blank, trimmed; most lines have no run and skip the regular expression."""
    low, runs = F.lower(line), reduce(or_, [F.contains(line, F.lit(w)) for w in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.trim(F.when(runs, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def _starts(width: int):
    """Starts of the shingles of the UTF-16 form ``b``; a form of less than ``width`` characters is one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("b") / 2).cast("int") - width))


def _shingle(i, width: int, form="b"):
    return F.substring(F.col(form) if isinstance(form, str) else form, i * 2 + 1, F.lit(2 * width))


def _set(normal: str, width: int):
    """Distinct 64-bit hashes of a normal form's shingles."""
    form = F.encode(F.col(normal), "UTF-16BE")
    hashes = F.transform(F.array(form), lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length(b) / 2).cast("int") - width)), lambda i: F.xxhash64(_shingle(i, width, b))))
    return F.array_distinct(F.get(hashes, F.lit(0)))


def _anchor(i: int) -> int:
    """A fixed 64-bit number; the least hash XOR anchor is of a uniformly random shingle, another for each anchor."""
    x = ((i + 1) * 0x9E3779B97F4A7C15 ^ ((i + 1) * 0xC2B2AE3D27D4EB4F >> 7)) % 2**64
    return x - 2**64 if x >= 2**63 else x


def _least(i: int):
    """The upper half of the least hash XOR anchor."""
    return F.shiftright(F.min(F.col("h").bitwiseXOR(F.lit(_anchor(i)))), 32).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, normal, key) of the lines that hold text; row tells the texts of one id apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("doc_id is not null and text is not null")
    rows = own.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "row", "pos", _normal(F.col("line")).alias("normal"))
    return rows.where("normal <> ''").withColumn("key", F.xxhash64("normal"))


def _minima(docs: DataFrame, width: int) -> DataFrame:
    """(key, m): the minima of every distinct line of ``docs``."""
    return _minima_of(_texts(docs), width)


def _minima_of(texts: DataFrame, width: int) -> DataFrame:
    """(key, m): the minima of every distinct line; texts are hashed where they are read, only minima are shuffled."""
    forms = texts.select("key", F.encode("normal", "UTF-16BE").alias("b"))
    each = forms.select("key", "b", F.explode(_starts(width)).alias("i")).select("key", F.xxhash64(_shingle(F.col("i"), width)).alias("h"))
    lines = each.groupBy("key").agg(*[_least(i).alias(f"m{i}") for i in range(MINIMA)])
    return lines.select("key", F.array(*[f"m{i}" for i in range(MINIMA)]).alias("m"))


def _forms(texts: DataFrame, keys: DataFrame, minima: DataFrame) -> DataFrame:
    """(key, m, t): minima and normal form of the given lines; the texts are read again and only theirs go further."""
    few = keys.count() <= SENT
    own = texts.select("key", F.col("normal").alias("t")).join(F.broadcast(keys) if few else keys, "key", "left_semi")
    return own.groupBy("key").agg(F.first("t").alias("t")).join(minima, "key").select("key", "m", "t")


def _met(members: DataFrame, written: bool = False) -> DataFrame:
    """The rows (bucket, key, group, label) of buckets that hold lines not linked to one and the same line yet, beside the
    bucket's lead ``low`` (its smallest key), the lead's label and the bucket's size n."""
    dealt = members if written else materialise(members, "dealt")
    sizes = dealt.groupBy("bucket").agg(F.min("key").alias("low"), F.min_by("label", "key").alias("low_label"), F.min("label").alias("one"), F.max("label").alias("other"), F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.where("one <> other").drop("one", "other"), "sizes")
    if sizes.count() <= SENT:
        found = materialise(dealt.join(F.broadcast(sizes), "bucket"), "met")
    else:
        found = materialise(hot_join(dealt, sizes, "bucket", "n", dealt.count()), "met")
    drop(sizes, *[dealt] * (not written))
    return found


def _star(met: DataFrame) -> DataFrame:
    """(a, b, n): the lead and each member with another label; n bounds a's pairs in a bucket."""
    return met.where("key <> low and label <> low_label").select(F.col("low").alias("a"), F.col("key").alias("b"), "n")


def _all_pairs(met: DataFrame) -> DataFrame:
    """(a, b, n): the pairs of members with different labels in buckets of up to CROWD lines."""
    small = met.where(f"n <= {CROWD}").groupBy("bucket").agg(F.array_sort(F.collect_set(F.struct("key", "label"))).alias("lines"))
    later = lambda x, i: F.filter(F.slice("lines", i + 2, F.size("lines")), lambda y: y["label"] != x["label"])
    pairs = F.flatten(F.transform("lines", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")))))
    return small.select(F.explode(pairs).alias("p")).select("p.a", "p.b", F.lit(CROWD).cast("long").alias("n"))


def _beside(pairs: DataFrame, rows: DataFrame, end: str, *columns: str) -> DataFrame:
    """``pairs`` with the columns of ``rows`` for one end; a line with many pairs is joined in as many places as it needs."""
    parts = F.ceil(F.col("n") / SHARE)
    own = rows.select(F.col("key").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    if end == "b":
        return pairs.join(own, end)
    hubs = pairs.groupBy(end).agg(F.max(parts).alias("parts"))
    own = own.join(hubs, end).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return pairs.withColumn("part", F.pmod(F.xxhash64("b"), parts)).join(own, [end, "part"]).drop("part")


def _verified(pairs: DataFrame, tested: list[DataFrame], forms: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, tested pairs): of the pairs not tested yet those of which half of the minima agree are tested by their sets.

    Sets are made of the texts beside the pair, so that no set is written or shuffled.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
    if tested:
        pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
    agree = F.aggregate(F.zip_with("m_a", "m_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, v: n + v)
    likely = _beside(_beside(pairs, forms, "b", "m"), forms, "a", "m").where(agree >= MINIMA // 2).select("a", "b", "n")
    likely = materialise(likely, "likely")
    both = _beside(_beside(likely, forms, "b", "t"), forms, "a", "t")
    # Generators stand before the sets' use, so that each is made once a pair.
    sets = both.select("a", "b", F.inline(F.array(F.struct(_set("t_a", width).alias("s_a"), _set("t_b", width).alias("s_b")))))
    counts = F.array(F.struct(F.size(F.array_intersect("s_a", "s_b")).alias("common"), (F.size("s_a") + F.size("s_b")).alias("total")))
    met = sets.select("a", "b", F.inline(counts))
    links = materialise(met.where(F.col("common") >= threshold * (F.col("total") - F.col("common")) - 1e-9).select("a", "b"), "similar")
    return links, likely.select("a", "b")


def _labelled(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``members`` with label: the smallest lead that a line is linked with, or itself."""
    every = reduce(DataFrame.unionByName, links)
    ends = every.select(F.col("b").alias("key"), F.col("a").alias("label")).unionAll(every.select(F.col("a").alias("key"), F.col("a").alias("label")))
    labels = ends.groupBy("key").agg(F.min("label").alias("label"))
    return members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _by_bands(crowded: DataFrame, forms: DataFrame) -> DataFrame:
    """(bucket, key, group): the lines of crowded buckets (``group`` is the band that made one) by each of their other bands within the bucket."""
    other = F.filter(F.transform(_bands(), lambda band, i: F.when(i != F.col("group"), F.xxhash64("bucket", band))), lambda band: band.isNotNull())
    return crowded.join(forms.select("key", "m"), "key").select("key", F.explode(other).alias("again")).select(F.col("again").alias("bucket"), "key", F.lit(0).cast("long").alias("group")).distinct()


def _by_leads(crowded: DataFrame) -> DataFrame:
    """(bucket, low, key, group, n): crowded buckets of one group that have the same lead are one bucket from here on.

    What their lines have beside the leads is the same in each, so a line stands there once, not once a bucket.
    """
    same = crowded.groupBy("group", "low", "key").agg(F.max("n").alias("n"))
    return same.withColumn("bucket", F.xxhash64("group", "low"))


def _deeper(crowded: DataFrame, rests: DataFrame | None, forms: DataFrame, width: int) -> DataFrame:
    """(group, key, h): the hashes of each line's shingles that neither its bucket's lead nor an earlier one has."""
    pairs = _by_leads(crowded).select(F.col("low").alias("a"), F.col("key").alias("b"), "bucket", "group", "n")
    # A lead's set is made once, not beside each of its lines.
    leads = forms.join(pairs.select(F.col("a").alias("key")).distinct(), "key", "left_semi").select("key", _set("t", width).alias("s"))
    met = _beside(pairs, leads, "a", "s")
    if rests is None:
        met = _beside(met, forms, "b", "t").withColumn("left", _set("t_b", width))
    else:
        met = met.join(rests.select("group", F.col("key").alias("b"), F.col("h").alias("left")), ["group", "b"])
    rest = met.select(F.col("bucket").alias("group"), F.col("b").alias("key"), F.explode(F.array(F.array_except("left", "s_a"))).alias("h"))
    return rest.where(F.size("h") > 0)


def _redealt(rests: DataFrame, n: int) -> DataFrame:
    """(bucket, key, group): lines of a group that share one of ``n`` least hashes of what their leads lack."""
    least = rests.select("group", "key", F.explode("h").alias("h")).groupBy("group", "key").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(_anchor(MINIMA + i)))).alias(f"m{i}") for i in range(n)])
    buckets = F.array(*[F.xxhash64("group", F.lit(i), f"m{i}") for i in range(n)])
    return least.select("group", "key", F.explode(buckets).alias("bucket"))


def _bands():
    return F.array(*[F.xxhash64(F.lit(b), *[F.col("m")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])


def similar_lines(texts: DataFrame, minima: DataFrame, width: int = 9, threshold: float = 0.8) -> DataFrame:
    """Verified links (a, b) between distinct keys; ``minima`` (which goes when it is used) are those of ``texts``."""
    met = _met(minima.select("key", F.col("key").alias("label"), F.posexplode(_bands()).alias("group", "bucket")), written=True)
    keys = materialise(met.select("key").distinct(), "keys")
    forms = materialise(_forms(texts, keys, minima), "forms")
    drop(keys)
    drop(minima)
    links, tested, rests, turn = [], [], None, 0

    def verify(pairs: DataFrame) -> None:
        found, looked_at = _verified(pairs, tested, forms, width, threshold)
        links.append(found)
        tested.append(looked_at)

    verify(_star(met))
    again = _met(_labelled(met.select("bucket", "key", "group"), links))
    drop(met)
    met = again
    while True:
        crowded = met.where(f"n > {CROWD}")
        pairs = _all_pairs(met) if turn == 0 else _all_pairs(met).unionByName(_star(crowded))
        deeper = not crowded.isEmpty()
        if turn == 0 and deeper:  # the pairs of small buckets go with those of the crowded ones' other bands
            again = _met(_labelled(_by_bands(crowded, forms), links))
            pairs = pairs.unionByName(_all_pairs(again)).unionByName(_star(again.where(f"n > {CROWD}")))
            crowded = again.where(f"n > {CROWD}")
            verify(pairs)
            # A lead's buckets are one group from here on.
            crowded = crowded.groupBy("low", "key").agg(F.max("n").alias("n")).select(F.col("low").alias("bucket"), "key", F.lit(0).cast("long").alias("group"))
            drop(met)
            met = _met(_labelled(crowded, links))
            drop(again)
            crowded = met.where(f"n > {CROWD}")
        else:
            verify(pairs)
        if not deeper or crowded.isEmpty():
            break
        done, rests = rests, materialise(_deeper(crowded, rests, forms, width), "rests")
        drop(*[done] * (done is not None))
        again = _met(_labelled(_redealt(rests, DEEPEST if turn else DEEPER), links))
        drop(met)
        met, turn = again, turn + 1
    drop(met, forms, *tested, *[rests] * (rests is not None))
    return reduce(DataFrame.unionByName, links)


def removed_lines(docs: DataFrame, width: int = 9, threshold: float = 0.8) -> DataFrame:
    """(doc_id, row, pos) of each line that repeats or nearly repeats an earlier one."""
    lines = materialise(_texts(docs), "lines")  # split and folded once; each later step reads the columns it names
    minima = materialise(_minima_of(lines, width), "minima")
    parts = connected_components(similar_lines(lines, minima, width, threshold))
    spot = F.struct("doc_id", "row", "pos")
    keys = lines.groupBy("key").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"))
    keys = keys.join(parts.select(F.col("node").alias("key"), "component"), "key", "left").where("n > 1 or component is not null")
    keys = materialise(keys.select("key", F.coalesce("component", "key").alias("part"), "first", "n"), "repeated")
    kept = keys.groupBy("part").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("size"))
    kept = materialise(hot_join(keys, materialise(kept, "kept"), "part", "size", keys.count()).select("key", "kept", "n"), "decided")
    return hot_join(lines.select("doc_id", "row", "pos", "key"), kept, "key", "n", lines.count()).where(spot != F.col("kept")).select("doc_id", "row", "pos")


def dedup_lines(docs: DataFrame, width: int = 9, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the repeated and nearly repeated lines of ``text`` gone; every document stays."""
    return _cut(docs, width, threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    gone = removed_lines(docs, width, threshold).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.array_sort("gone").alias("__gone"))
    own = docs.join(gone, (docs["doc_id"].cast("long") == gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__row"]), "left")
    # The lines between removed ones, from the end of one gap to the start of the next, so the work is linear in the text.
    gaps = F.concat(F.array(F.lit(-1)), "__gone"), F.concat("__gone", F.array(F.size(F.col("__lines"))))
    kept = F.flatten(F.transform(F.arrays_zip(gaps[0].alias("a"), gaps[1].alias("b")), lambda g: F.slice(F.col("__lines"), g["a"] + 2, g["b"] - g["a"] - 1)))
    own = own.withColumn("__lines", F.split("text", "\n")).withColumn("__n_gone", F.coalesce(F.size("__gone"), F.lit(0)))
    return own.withColumn("__n_lines", F.size("__lines")).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))


def line_report(docs: DataFrame, width: int = 9, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 of the remaining text (null text: the empty one)."""
    own = docs.select("doc_id", "text")
    cut = _cut(own, width, threshold)
    n = F.when(F.col("text").isNull() | (F.col("__n_lines") < 0), 0).otherwise(F.col("__n_lines"))
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("int").alias("n_lines"), F.greatest(F.lit(0), F.col("__n_gone")).cast("int").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
