"""Mixing sources to target weights by blocks of words.

The words of a source, in the order of its documents, are cut into the least number of blocks of at most `block` words, whose lengths
differ by one at most. The slots of each output shard are dealt to the sources by a multinomial draw: every slot draws its
source for itself, so a draw is exact at any size. Shards are drawn in rounds, three quarters of those left in each; a round's
probabilities are what the sources lack after the rounds before it, so sources come near their targets though every slot is drawn.
Slot i of a source holds the block that a pseudorandom permutation of its block indices (one per source and epoch) puts there. So
whether and where a block stands in the mix follows from its own index and the number of slots that its source drew: the join of slots to blocks by
index needs no shuffle. All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, keep, let, prefix_sum, tidy

WEIGHTS = (5, 2, 1)
BLOCK, SHARDS = 64, 64
MADE = ("size", "source_size", "target", "first", "taken")
#: Primes near 2**20; for any number of blocks below 2**43, one of them doesn't divide it, and no product overflows.
PRIMES = (1048573, 1048571, 1048559, 1048549, 1048517, 1048507, 1048447, 1048433, 1048423, 1048391)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """From (source, source_size): weight and target of each source.

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share `share` of all words; a target stops at `most` times its
    source, and the rest is shared again by weight until none is above. In the order of most * size / weight, a source
    stops if what is left for each unit of weight reaches that. One row per source meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    df = df.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(1))
    df = df.withColumns({"_all": F.sum("source_size").over(everything) * F.lit(share), "_caps": F.sum("cap").over(upto) - F.col("cap"), "_weights": F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")})
    df = df.withColumn("_stops", F.col("ratio") * F.col("_weights") <= F.col("_all") - F.col("_caps"))
    left = F.col("_all") - F.sum(F.when(F.col("_stops"), F.col("cap")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("weight"))).over(everything)
    df = df.withColumns({"_left": left, "_open": open_})
    target = F.when(F.col("_stops"), F.col("cap")).otherwise(F.col("_left") * F.col("weight") / F.greatest(F.col("_open"), F.lit(1)))
    return df.select("source", "source_size", "weight", target.alias("target"))


def _uniform(*key: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def draws(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, n): how many slots of each shard a source drew. plans: (sid, need, room), the slots it should and may have.

    Each round goes over its slots once, looks the source of a slot up by a uniform hash, and adds up. Sources lie side by side on a line, as wide
    as what they lack; the line has as many cells as sources, and a slot meets those of its cell only.
    """
    spark, at, counts = plans.sparkSession, 0, None
    w = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while at < shards:
        end = at + max(1, (shards - at) * 3 // 4)
        state = plans.withColumn("had", F.lit(0).cast("long")) if counts is None else plans.join(counts.groupBy(F.col("sid").alias("_s")).agg(F.sum("n").alias("had")), F.col("sid") == F.col("_s"), "left").fillna(0, ["had"])
        lack = F.when(F.col("room") > F.col("had"), F.greatest(F.col("need") - F.col("had"), F.lit(0.0))).otherwise(0.0)
        state = state.select("sid", (F.col("room") - F.col("had")).alias("room"), lack.alias("lack")).filter("lack > 0")
        state = keep(state.withColumn("hi", F.sum("lack").over(upto)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0))), "lack")
        total, cells = state.agg(F.max("hi"), F.count("*")).first()
        slots = round((total or 0) * (end - at) / (shards - at))
        if slots:
            cell = lambda x: F.least(F.floor(x / F.lit(total) * F.lit(cells)), F.lit(cells - 1))
            side = state.select("sid", "room", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_cell"))
            shard = F.lit(at) + F.floor(F.col("id") * (end - at) / slots)
            rows = spark.range(slots).select(shard.cast("int").alias("shard"), (_uniform(F.lit(seed), F.lit(at), F.col("id")) * total).alias("x"))
            rows = rows.withColumn("_cell", cell(F.col("x"))).join(side, "_cell").filter("x >= lo and x < hi")
            drawn = rows.groupBy("sid", "room", "shard").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(w) - F.col("n"))
            drawn = drawn.select("sid", "shard", F.greatest(F.least("n", F.col("room") - F.col("_before")), F.lit(0)).cast("long").alias("n")).filter("n > 0")
            counts = keep(drawn if counts is None else counts.unionByName(drawn), "drawn")
        at = end
    return counts if counts is not None else plans.select("sid", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("n")).limit(0)


def keys_of(n: Column, epochs: int, *key: Column) -> Column:
    """For each epoch the constants of its permutation of 0 .. n-1: a multiplier without common factor and an addend for each round, and a salt."""
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])

    def one(e: int) -> Column:
        hashed = lambda r, j: F.xxhash64(*key, F.lit(e), F.lit(r), F.lit(j))
        fit = F.filter(primes, lambda p: n % p != 0)
        mul = [F.get(fit, F.pmod(hashed(r, 0), F.size(fit)).cast("int")).alias(f"m{r}") for r in range(3)]
        add = [F.pmod(hashed(r, 1), n).alias(f"a{r}") for r in range(3)]
        return F.struct(*mul, *add, hashed(9, 9).alias("salt"))

    return F.when(n > 0, F.array(*[one(e) for e in range(epochs)]))


def permuted(i: Column, n: Column, k: Column) -> Column:
    """Where the permutation with constants k puts i: multiply and add modulo n, turn within chunks, and again."""

    def turn(x: Column, size: int) -> Column:
        chunk = x - x % size
        length = F.least(F.lit(size).cast("long"), n - chunk)
        return chunk + F.pmod(x - chunk + F.pmod(F.xxhash64(k["salt"], chunk), length), length)

    x = (i * k["m0"] + k["a0"]) % n
    return let(let(x, lambda x: (turn(x, 7) * k["m1"] + k["a1"]) % n), lambda x: (turn(x, 61) * k["m2"] + k["a2"]) % n)


def _epochs(most: float) -> int:
    return int(most) + (most > int(most))


def plan(sizes: DataFrame, block: int, shards: int, seed: int, **how) -> DataFrame:
    """targets() with n_blocks, n_slots and `bounds`: the first slot of each shard and the end. One row per source.

    A source with a target that drew no slot has one, in a shard that its number decides, so that tiny sources stay in the mix.
    """
    df = targets(sizes, **how)
    df = df.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    df = df.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    length = F.col("source_size") / F.greatest("n_blocks", F.lit(1))  # mean words of a block
    some = (F.col("source_size") > 0) & (F.col("target") > 0)
    df = df.withColumn("need", F.when(some, F.col("target") / length).otherwise(0.0))
    df = df.withColumn("room", F.when(some, F.floor(F.lit(how.get("most", 2.0)) * F.col("n_blocks"))).otherwise(0).cast("long"))
    df = df.withColumn("keys", keys_of(F.col("n_blocks"), _epochs(how.get("most", 2.0)), F.coalesce("source", F.lit("\0")), F.lit(seed)))
    df = keep(df, "targets")
    drawn = draws(df.select("sid", "need", "room"), shards, seed)
    drawn = drawn.groupBy(F.col("sid").alias("_s")).agg(F.collect_list(F.struct("shard", "n")).alias("_n"))  # a struct per shard at most
    df = df.join(drawn, F.col("sid") == F.col("_s"), "left")
    alone = F.array(F.struct(F.pmod(F.xxhash64("sid"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).cast("long").alias("n")))
    df = df.withColumn("_n", F.coalesce("_n", F.when(F.col("room") > 0, alone).otherwise(F.array())))
    before = lambda k: F.aggregate(F.filter("_n", lambda x: x["shard"] < k), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    df = df.withColumn("bounds", F.transform(F.sequence(F.lit(0), F.lit(shards)), before))
    return df.withColumn("n_slots", F.element_at("bounds", -1)).drop("_n", "_s", "sid", "need", "room")


@tidy
def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: list[str] | None = None, block: int = BLOCK, shards: int = SHARDS, seed: int = 9, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """carry (default: all columns) with size, source_size, target, first (the document's first word in its source) and `taken`; these replace columns of docs of the same name.

    taken is an array with one (block, from, words, epoch, slot, shard) for each part of the document that the mix holds: words of the
    document from word `from` on, in this block, at this slot of this shard. Null or blank texts have size 0 and no part; null
    source is a source of its own, last in order; repeated rows are documents of their own; an empty table gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in MADE]
    size = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = keep(docs.select(*kept, F.col(source).cast("string").alias("source"), F.col(key).alias("_key"), content.alias("_hash"), size.alias("size")), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    plans = keep(plan(sizes.select("source", "source_size"), block, shards, seed, share=share, most=most), "plan")
    rows = prefix_sum(rows, ["source"], ["_key", "_hash"], "size", "first", rows.count())
    rows = rows.join(plans.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    n, slots = F.col("n_blocks"), F.col("n_slots")
    longer = F.col("source_size") % n  # so many blocks, the first ones, have a word more than the others
    length = ((F.col("source_size") - longer) / n).cast("long")
    start = lambda b: b * length + F.least(b, longer)

    def holder(word: Column) -> Column:
        """The block that holds this word of the source."""
        after = word - longer * (length + 1)
        return F.when(after < 0, (word - word % (length + 1)) / (length + 1)).otherwise(longer + (after - after % length) / length).cast("long")

    def part(b: Column, slot: Column, epoch: int) -> Column:
        begin = F.greatest(start(b), F.col("first"))
        end = F.least(start(b + 1), F.col("first") + F.col("size"))
        shard = F.size(F.filter("bounds", lambda x: x <= slot)) - 1
        return F.struct(b.alias("block"), (begin - F.col("first")).alias("from"), (end - begin).alias("words"), F.lit(epoch).alias("epoch"), slot.alias("slot"), shard.alias("shard"))

    span = F.sequence(holder(F.col("first")), holder(F.col("first") + F.col("size") - 1))
    placed = lambda e: F.transform(span, lambda b: F.struct(b.alias("b"), (n * e + permuted(b, n, F.get("keys", F.lit(e)))).alias("slot")))
    held = lambda e: F.transform(F.filter(placed(e), lambda x: x["slot"] < slots), lambda x: part(x["b"], x["slot"], e))
    parts = F.concat(*[held(e) for e in range(_epochs(most))])
    kind = "array<struct<block:bigint,from:bigint,words:bigint,epoch:int,slot:bigint,shard:int>>"
    taken = F.when((F.col("size") > 0) & (slots > 0), parts).otherwise(F.array().cast(kind)).cast(kind)
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "size", "source_size", "target", "first", taken.alias("taken"))


def blocks(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix as blocks: (shard, source slot order, parts) where parts lists (key, from, words), joined by block index."""
    part = mixed.select(key, "source", F.explode("taken").alias("x"))
    return part.groupBy("source", "x.shard", "x.slot", "x.block").agg(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("x.from"), F.col("x.words")))).alias("parts"))


@tidy
def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """The columns of docs, with one row for each document and epoch of which the mix holds words.

    A document taken whole keeps its text as it is; otherwise its text is the taken words in order, each with the white space after it.
    Null and blank texts hold no word and are not in the mix; null keys and sources are values like others; repeated rows are documents
    of their own, dealt to places by a hash of all their columns, so reruns agree; columns of any name stay; an empty table gives an empty result.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    marks = [F.col(how.pop("key", "doc_id")), F.col(how.get("source", "source"))]
    named = F.md5(F.concat_ws("\1", *[F.coalesce(c.cast("string"), F.lit("\2")) for c in marks], F.md5(F.coalesce(text, F.lit("\2")))))
    rows = docs.select(named.alias("_id"), F.col(text).alias("_t"), F.col(how.pop("source", "source")).alias("_source"))
    parts = mix(rows, text="_t", source="_source", key="_id", carry=["_id"], **how)
    # Texts move once, to their id. Only where several rows share an id, the n-th row also has to find the n-th place of it.
    parts = parts.select(F.col("_id").alias("_p"), "first", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    parts = keep(parts, "parts")
    again = keep(parts.groupBy(F.col("_p").alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again"), "again")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text).alias("_t"), named.alias("_id"))
    some = ("_doc", "_t", "_size", "_taken")
    if again.isEmpty():
        df = marked.join(parts, F.col("_id") == F.col("_p")).select(*some)
    else:
        one = marked.join(again, F.col("_id") == F.col("_again"), "left_anti").join(parts, F.col("_id") == F.col("_p")).select(*some)
        rank = lambda by, order: F.row_number().over(Window.partitionBy(by).orderBy(order))
        rows = marked.join(again, F.col("_id") == F.col("_again"), "left_semi").withColumn("_copy", rank("_id", F.xxhash64(F.to_json("_doc"))))
        places = parts.join(again, F.col("_p") == F.col("_again"), "left_semi").withColumn("_place", rank("_p", "first"))
        df = one.unionByName(rows.join(places, (F.col("_id") == F.col("_p")) & (F.col("_copy") == F.col("_place"))).select(*some))
    df = df.withColumn("_epoch", F.explode(F.array_distinct(F.transform("_taken", lambda x: x["epoch"]))))
    df = df.withColumn("_mine", F.array_sort(F.transform(F.filter("_taken", lambda x: x["epoch"] == F.col("_epoch")), lambda x: F.struct(x["from"].alias("a"), x["words"].alias("n")))))
    df = df.withColumn("_n", F.aggregate("_mine", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    tokens = F.regexp_extract_all(F.regexp_replace("_t", f"^{SPACE}", ""), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    df = df.withColumn("_words", F.when(F.col("_n") < F.col("_size"), tokens))
    part = F.rtrim(F.array_join(F.flatten(F.transform("_mine", lambda x: F.slice("_words", (x["a"] + 1).cast("int"), x["n"].cast("int")))), ""))
    df = df.withColumn("_text", F.when(F.col("_n") < F.col("_size"), part).otherwise(F.col("_t")))
    out = {text: F.col("_text")} | ({n_chars: F.length("_text").cast(kinds[n_chars])} if n_chars in columns else {})
    return df.select(*[out.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])
