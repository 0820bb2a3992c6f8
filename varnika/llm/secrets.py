"""Secret scans: patterns find candidates, and the corpus tells live credentials from widely copied examples.

Each candidate value is hashed, and its hash is aggregated over all documents by distinct repositories (equal texts are
copies of one repository) and distinct owners (`source`). A value held by more than `max_owners` owners, or by several owners and
more than `max_repos` repositories, is an example that is copied around; any other is owner-specific and looks live, however often
its one owner repeats it. Besides the base kinds (assign, access, hex), the method adds spans of kind `opaque` (long tokens of mixed
case with digits) that no base span touches, where it looks live. scan() gives the spans of all kinds with their verdict. All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, tidy

#: Kind, pattern, group with the value, least length of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Elements of a block in running sums and greatest values.
BLOCK = 128
#: Code points of a piece of text when it is masked.
PIECE = 4096
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: What must not stand before the first sign of a run, so that whether there is one is not tried from each of its signs.
STARTS = {"hex": "(?<![0-9a-f])", "opaque": "(?<![A-Za-z0-9+/_-])"}
SPAN = "struct<s:int,k:int,e:int,v:string>"


def _running(values: Column) -> Column:
    """The sums of an array of integers up to and with each element: blocks first, then within a block.

    An aggregate that grows an array would copy all of it, deeply, at each step.
    """
    add = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)

    def sums(c: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / BLOCK).cast("int")), lambda b: add(F.slice(c, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(totals, lambda t: F.transform(t, lambda _, b: add(F.slice(t, F.lit(1), b))))
        return let(before, lambda t: F.transform(c, lambda _, i: F.get(t, F.floor(i / BLOCK).cast("int")) + add(F.slice(c, i - i % BLOCK + 1, i % BLOCK + 1))))

    return let(values, sums)


def _tops(values: Column) -> Column:
    """The greatest value of each block of an array."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def _top(values: Column, tops: Column, i: Column) -> Column:
    """The greatest value before place i, 0 at least; tops are those of values."""
    return F.greatest(F.array_max(F.slice(tops, F.lit(1), F.floor(i / BLOCK).cast("int"))), F.array_max(F.slice(values, i - i % BLOCK + 1, i % BLOCK)), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, group: int, least: int, start: str = "") -> Column:
    """The leftmost non-overlapping matches as (start, kind, end, value), in code points.

    The pieces between the matches and the matches themselves, added up by length, give the places.
    """

    def places(x: Column) -> Column:
        steps = F.transform(x["hit"], lambda h, i: F.length(F.get(x["gap"], i)) + F.length(h))
        span = lambda h, i, ends: F.struct((F.get(ends, i) - F.length(h)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e"), F.get(x["value"], i).alias("v"))
        return let(_running(steps), lambda ends: F.transform(x["hit"], lambda h, i: span(h, i, ends)))

    p = F.lit(pattern)
    found = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    some = F.filter(let(found, places), lambda x: F.length(x["v"]) >= least)
    return F.when(text.rlike(start + pattern), some).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(base: Column, opaque: Column) -> Column:
    """The opaque spans that no base span overlaps. Both come by start, and opaque spans don't overlap each other, so one sweep tells.

    A base span that starts earlier reaches into an opaque one if the greatest end so far does; one that starts within it is the next in order.
    """
    tagged = lambda spans, tag: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(tag).alias("tag"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))

    def sweep(m: Column) -> Column:
        ends = F.transform(m, lambda x: F.when(x["tag"] == 0, x["e"]).otherwise(0))

        def free(c: Column, t: Column) -> Column:
            def apart(x: Column, i: Column) -> Column:
                after = F.get(m, i + 1)
                return (x["tag"] == 1) & (x["s"] >= _top(c, t, i)) & ~F.coalesce((after["tag"] == 0) & (after["s"] < x["e"]), F.lit(False))

            return F.filter(m, apart)

        found = let(ends, lambda c: let(_tops(c), lambda t: free(c, t)))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))

    return F.when(F.size(opaque) > 0, let(F.array_sort(F.concat(tagged(base, 0), tagged(opaque, 1))), sweep)).otherwise(opaque)


def suspect(text: Column) -> Column:
    """Whether a pattern matches at all: a text where none does has no span. A run of signs is tried from its start only."""
    found = text.rlike(STARTS["opaque"] + OPAQUE)
    for kind, pattern, _, _ in KINDS:
        found = text.rlike(STARTS.get(kind, "") + pattern) | found
    return found


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_base` and `_opaque`: arrays of (s, k, e, v) by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[_spans(t, p, k, g, n, STARTS.get(name, "")) for k, (name, p, g, n) in enumerate(KINDS)]))
    mixed = lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]")
    df = docs.withColumns({"_base": base, "_opaque": F.filter(_spans(t, OPAQUE, len(KINDS), 0, 24, STARTS["opaque"]), mixed)})
    return df.withColumn("_opaque", _apart(F.col("_base"), F.col("_opaque")))


def ownership(found: DataFrame, max_owners: int = 2, max_repos: int = 10) -> DataFrame:
    """From rows (h, owner, repo): one row per hash with n_owners, n_repos and live.

    Both counts are of distinct values, found by grouping on the pair first, so a value in a third of all rows meets in no task.
    """
    owners = found.select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("n_owners"))
    repos = found.select("h", "repo").distinct().groupBy("h").agg(F.count("*").alias("n_repos"))
    df = owners.join(repos, "h")
    return df.withColumn("live", (F.col("n_owners") <= max_owners) & ((F.col("n_owners") == 1) | (F.col("n_repos") <= max_repos)))


@tidy
def scan(docs: DataFrame, text: str = "text", owner: str = "source", carry: list[str] | None = None, max_owners: int = 2, max_repos: int = 10, again: bool = False) -> DataFrame:
    """carry (default: all columns) with `_spans`: an array of (s, k, e, live) for each row, by start, then kind; a column of docs of that name is replaced.

    carry and candidates of all rows are written to a table, so texts are matched once. With `again`, only rows whose text a pattern matches are written, and all others go
    from docs to the result: docs is read and matched twice, which is better where carry holds the texts. Very long texts are matched whole.
    k is the index in KINDS, or 3 for opaque. Null text counts as empty and has no span; null owners are one owner; repeated rows
    each get their spans and count once as repository; an empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in carry]).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("_who"))
    found = rows.filter(suspect(F.col("_text"))) if again else rows
    seen = candidates(found, "_text").select("_doc", "_base", "_opaque", F.col("_who").alias("_owner"), "_text", F.monotonically_increasing_id().alias("_rid"))
    some = (F.size("_base") > 0) | (F.size("_opaque") > 0)
    seen = keep(seen.withColumn("_repo", F.when(some, F.sha2("_text", 256))).drop("_text"), "scan")
    hit = seen.filter("_repo is not null")
    each = keep(hit.select("_rid", "_repo", "_owner", F.explode(F.concat("_base", "_opaque")).alias("x")).select("_rid", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), "x.s", "x.k", "x.e", F.sha2("x.v", 256).alias("h")), "secrets")
    verdict = keep(ownership(each, max_owners, max_repos), "owners").select("h", "live")
    judged = each.join(verdict, "h")
    by_row = judged.groupBy(F.col("_rid").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "live"))).alias("_spans"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,live:boolean>>")
    joined = hit.join(by_row, F.col("_rid") == F.col("_of"), "left").select("_doc", F.coalesce("_spans", none).alias("_spans"))
    clean = seen.filter("_repo is null").select("_doc", none.alias("_spans"))
    both = joined.unionByName(clean)
    if again:
        both = both.unionByName(rows.filter(~suspect(F.col("_text"))).select("_doc", none.alias("_spans")))
    return both.select(*[F.col(f"_doc.`{c}`").alias(c) for c in carry if c != "_spans"], "_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("opaque"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the SHA-256 of the base spans, `spans` (base spans, and opaque ones that look live: a value that many owners copy is no secret of theirs), and `verdicts` (live or example) of all spans, in their order."""
    count = lambda k: F.size(F.filter("_spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["k"] < len(KINDS))
    cols = {f"n_{kind}": count(k) for k, (kind, *_) in enumerate(KINDS)}
    cols |= {"n_opaque": count(len(KINDS)), "n_live": F.size(F.filter("_spans", lambda x: x["live"])).cast("long")}
    return scanned.withColumns(cols | {"base_sha256": F.sha2(listed(base), 256), "spans": listed(F.filter("_spans", lambda x: (x["k"] < len(KINDS)) | x["live"])), "verdicts": F.array_join(F.transform("_spans", lambda x: F.when(x["live"], "live").otherwise("example")), ",")}).drop("_spans")


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by [SECRET] (if one of them looks live) or [EXAMPLE].

    What stands between runs is taken from pieces of the text, and where a run begins follows from the greatest end in blocks of spans. So
    time grows with the length and the number of spans, not with their product.
    """
    n = F.size(spans)

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        def part(r: Column, k: Column) -> Column:
            skip = F.greatest(r["a"] - k * PIECE, F.lit(0))
            return F.substring(F.get(pieces, k), skip + 1, F.least(r["b"] - k * PIECE, F.lit(PIECE)) - skip)

        at = lambda x: F.floor(x / PIECE).cast("int")
        joined = lambda r: F.array_join(F.transform(F.sequence(at(r["a"]), at(r["b"] - 1)), lambda k: part(r, k)), "")
        return let(F.struct(start.alias("a"), end.alias("b")), lambda r: F.when(r["b"] > r["a"], joined(r)).otherwise(""))

    def masked(x: Column) -> Column:
        before = lambda i: _top(x["ends"], x["tops"], i)

        def runs(firsts: Column) -> Column:
            def run(i: Column, j: Column) -> Column:
                live = F.exists(F.slice(spans, i + 1, F.coalesce(F.get(firsts, j + 1), n) - i), lambda s: s["live"])
                return F.concat(cut(x["pieces"], before(i), F.get(spans, i)["s"]), F.when(live, F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]")))

            return F.concat(F.array_join(F.transform(firsts, run), ""), cut(x["pieces"], before(n), F.length(text)))

        return let(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(spans, i)["s"] >= before(i)), runs)

    ends = F.transform(spans, lambda s: s["e"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(n > 0, let(F.struct(pieces.alias("pieces"), ends.alias("ends"), _tops(ends).alias("tops")), masked)).otherwise(text)
