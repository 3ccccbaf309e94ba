"""Native text spans: matches of a regular expression with their places in code points.

Arrays of spans are folded in chunks of about the square root of their number: a fold that
appends copies what it has so far, so that n matches cost n * sqrt(n) copies, not n * n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,before:string>"
#: Code points before a span that it keeps.
CONTEXT = 24
NONE = f"array<{SPAN}>"


def let(value: Column, fn) -> Column:
    """fn of a value that is evaluated once, however often fn names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def chunks(items: Column, many: Column) -> Column:
    """The items in order, in arrays of about the square root of their number `many`, which is above 0."""
    size = F.ceil(F.sqrt(many)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((many - 1) / size).cast("int")), lambda g: F.slice(items, g * size + 1, size))


def before(values: Column, start: Column, fold) -> Column:
    """For each of a few values: `start`, folded with all values before it."""
    return F.slice(F.aggregate(values, F.array(start), lambda s, x: F.concat(s, F.array(fold(F.element_at(s, -1), x)))), 1, F.size(values))


def located(text: Column, pattern: str, found: Column, kind: str, rank: int, ok=None) -> Column:
    """Spans of the matches `found` (all of `pattern` in order) whose value is `ok`: what lies between the matches gives their places.

    `before` holds up to CONTEXT code points before the span, as far as the match before the last.
    """
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    tail = lambda c: F.right(c, F.lit(CONTEXT))
    last = F.concat(F.array(F.lit("")), F.transform(F.slice(found, 1, F.size(found) - 1), tail))
    near = F.zip_with(last, between, lambda v, b: F.struct(F.length(b).cast("bigint").alias("b"), tail(F.concat(v, tail(b))).alias("c")))
    steps = F.zip_with(near, found, lambda x, v: F.struct(x["b"].alias("b"), x["c"].alias("c"), F.length(v).alias("n"), v.alias("v")))

    def add(s, x):
        a, e = s["at"] + x["b"], s["at"] + x["b"] + x["n"]
        span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"), x["c"].alias("before")).cast(SPAN)
        more = F.concat(s["out"], F.array(span))
        return F.struct(e.alias("at"), (F.when(ok(x["v"]), more).otherwise(s["out"]) if ok else more).alias("out"))

    def placed(group, at):
        return F.aggregate(group, F.struct(at.alias("at"), none().alias("out")), add, lambda s: s["out"])

    def over(groups):
        long = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] + x["n"]))
        return F.flatten(F.zip_with(groups, before(long, F.lit(0).cast("bigint"), lambda s, x: s + x), placed))

    made = let(steps, lambda s: let(chunks(s, F.size(s)), over))
    return F.when(F.exists(found, ok) if ok else F.size(found) > 0, made).otherwise(none())


def none() -> Column:
    return F.array().cast(NONE)


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`, which are sorted."""
    blocks = F.transform(
        chunks(others, F.size(others)),
        lambda g: F.struct(F.get(g, 0)["start"].alias("start"), F.array_max(F.transform(g, lambda s: s["end"])).alias("end"), g.alias("all")),
    )
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    clear = lambda found: F.filter(spans, lambda a: ~F.exists(found, lambda g: meets(a, g) & F.exists(g["all"], lambda b: meets(a, b))))
    return F.when((F.size(others) > 0) & (F.size(spans) > 0), let(blocks, clear)).otherwise(spans)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start, then kind as listed."""
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span replaced by mark(kind); a span that starts inside an earlier one goes with it."""
    part = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))

    def inside(own, group, at):
        """The text from `at` to the end of the group's spans: `own`."""

        def add(s, x):
            gap = part(own, s["at"] - at, F.greatest(x["start"] - s["at"], F.lit(0)))
            more = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, mark(x["kind"])))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), more.alias("out"))

        return F.aggregate(group, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), add, lambda s: F.concat_ws("", s["out"]))

    def over(groups):
        ends = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
        starts = before(ends, F.lit(0).cast("bigint"), lambda s, x: F.greatest(s, x))
        pieces = F.zip_with(groups, starts, lambda g, at: let(part(text, at, F.greatest(F.array_max(F.transform(g, lambda s: s["end"])) - at, F.lit(0))), lambda own: inside(own, g, at)))
        return F.concat(F.concat_ws("", pieces), part(text, F.array_max(ends), F.lit(2**31 - 1)))

    made = let(F.sort_array(spans), lambda s: let(chunks(s, F.size(s)), over))
    return F.when(F.size(spans) > 0, made).otherwise(text)
