"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base patterns find. A seed's left context (the last word before it and the marks after that) is a
lexical pattern; identifier-like tokens that no base pattern covers are unlabelled instances of the pattern before them.
Over the graph of patterns and distinct instances Spark then iterates: a pattern's confidence in a kind is the labelled
share of its instances, an instance's score the noisy-or of its patterns; instances over the bar count as labelled in the
next round. A token that would match a base pattern if it stood alone is labelled from the start. In the end, occurrences of such an instance after a confident pattern are spans, too. All of a text's spans
follow from the text, so discovered ones are keyed by its digest and copies are worked on once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: What the base patterns come to with possessive loops and with the checks of run lengths taken in: matches start only
#: where a run starts or the last match ended, so that no start is tried in vain along a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Tokens of 6 to 64 characters with four digits or an at sign: what may be an identifier.
TOKEN = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z0-9@._%+()-]{6,64}+(?![A-Za-z0-9@._%+()-]))(?=[^0-9@\s]*+(?:@|(?:[0-9][^0-9\s]*+){4}))[A-Za-z0-9@._%+()-]{5,63}[A-Za-z0-9]"
#: A phone number's usual groups, for one that a longer run of digits and spaces goes on from.
GROUPS = r"\+[0-9]{1,3}[\x20-]?\([0-9]{1,4}\)[\x20-]?[0-9]{2,4}(?:[\x20-][0-9]{2,4}){0,2}(?![0-9]|\.[0-9])"
#: What an instance must look like to be of a kind.
SHAPE = {"email": r"@|\bat\b", "ip": r"^[0-9.:]+$", "card": r"^[0-9-]{12,}$", "phone": r"^[0-9().+-]{7,}$"}
CONTEXT = r"(\p{L}{2,24}[^\p{L}\p{N}]{0,6})$"
#: Distinct labelled instances that a pattern needs, its least confidence, and an instance's least score.
SUPPORT, CONFIDENCE, SCORE = 3, 0.7, 0.7


def found(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct<start, end, value, before>> of a pattern's matches, in code points; before: the 40 characters before."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,value:string,before:string>>"
    walk = F.aggregate(
        F.filter(F.arrays_zip(pieces.alias("piece"), values.alias("value")), lambda x: x["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["at"] + F.length(x["piece"])).alias("start"), (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.right(x["piece"], F.lit(40)).alias("before"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(hint), walk).otherwise(F.array().cast(kind)) if hint else walk


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    d = F.reverse(digits(value))

    def worth(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def kinded(kind: int, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[span[c].alias(c) for c in ("start", "end", "value", "before")])


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")) < 4) & F.forall(F.split(value, r"\."), lambda x: F.right(x, F.lit(9)).cast("int") <= 255)
    if kind == "card":
        return luhn(value)
    return F.length(digits(value)).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value, before>>: the base patterns' valid matches, by kind as listed, then start."""
    own = []
    for k, kind in enumerate(KINDS):
        good = F.filter(found(text, BASE[kind], HINT[kind]), partial(valid, kind))
        own.append(F.transform(good, partial(kinded, k)))
    return F.concat(*own)


def context(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, CONTEXT, 1))


def scan(docs: DataFrame, key: str | None, text: str) -> DataFrame:
    """(key, digest, base, tokens) of every row, cut: all that later steps need of the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = [F.col(key).alias("key")] if key else []
    own = docs.select(*keys, F.sha1(t).alias("digest"), base_spans(t).alias("base"), F.concat(found(t, TOKEN, r"[0-9]|@"), found(t, GROUPS, HINT["phone"])).alias("tokens"))
    apart = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return cut(own.select(*(["key"] if key else []), "digest", "base", apart.alias("tokens")))


def discover(scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, score: float = SCORE) -> DataFrame:
    """(digest, extra): the discovered spans of each distinct text that has some, array<struct<kind, start, end>>.

    Pairs of pattern and instance are made distinct before they are shuffled further, and counts are pre-aggregated; what
    is joined is cut, so a pattern or an instance with a large share of the pairs is split. Rounds end when one adds no
    pattern and no instance; as masses and scores only grow, none that was added goes.
    """
    seeds = scanned.select(F.explode("base").alias("s")).select(context(F.col("s.before")).alias("pattern"), F.lower("s.value").alias("instance"), F.col("s.kind").alias("kind"))
    tokens = scanned.select("digest", F.explode("tokens").alias("s")).select("digest", context(F.col("s.before")).alias("pattern"), F.lower("s.value").alias("instance"), "s.start", "s.end")
    tokens = cut(tokens.distinct().withColumn("own", alone(F.col("instance"))))
    whole = tokens.filter("own is not null")
    open_ = tokens.filter("own is null and pattern <> ''")
    labelled = cut(seeds.unionByName(whole.select("pattern", "instance", F.col("own").alias("kind"))).filter("pattern <> ''").distinct())
    patterns = labelled.select("pattern").distinct()
    # only patterns that some seed induced, and what follows them
    loose = cut(open_.select("pattern", "instance").distinct().join(patterns, "pattern", "left_semi"))
    totals = cut(labelled.select("pattern", "instance").unionByName(loose).distinct().groupBy("pattern").agg(F.count("*").alias("n")))
    fits = F.array_compact(F.array(*[F.when(F.col("instance").rlike(SHAPE[kind]), F.lit(k)) for k, kind in enumerate(KINDS)]))
    shaped = cut(loose.select("pattern", "instance", F.explode(fits).alias("kind")))
    learnt = labelled.select("pattern", "kind").limit(0)
    scores = shaped.select("instance", "kind", F.lit(0.0).alias("s")).limit(0)
    last, now = None, (0, 0)
    while now != last:
        known = labelled.select("pattern", "kind", "instance", F.lit(1.0).alias("s")).unionByName(shaped.join(scores, ["instance", "kind"]).select("pattern", "kind", "instance", "s"))
        sums = cut(known.groupBy("pattern", "kind").agg(F.sum("s").alias("mass"), F.count("*").alias("k")), bare=True)
        learnt = cut(sums.join(totals, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("c"), "mass").filter((F.col("mass") >= support) & (F.col("c") >= confidence)).select("pattern", "kind", "c"), bare=True)
        reached = shaped.join(learnt, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("s"))
        scores = cut(reached.filter(F.col("s") >= score), bare=True)
        last, now = now, (learnt.count(), scores.count())
    sure = shaped.join(learnt.select("pattern", "kind"), ["pattern", "kind"]).join(scores, ["instance", "kind"]).groupBy("pattern", "instance").agg(F.max(F.struct("s", F.negate("kind").alias("k")))["k"].alias("k"))
    sure = cut(sure.select("pattern", "instance", F.negate("k").alias("kind")))
    spans = open_.join(sure, ["pattern", "instance"]).unionByName(whole.withColumn("kind", F.col("own"))).select("digest", F.struct("kind", "start", "end").alias("span"))
    return cut(spans.groupBy("digest").agg(F.array_sort(F.collect_set("span")).alias("extra")))


def alone(token: Column) -> Column:
    """The kind of a token that is a valid identifier by itself, if what stands beside it kept a base pattern from it."""
    span = F.struct(token.alias("value"))
    return F.coalesce(*[F.when(token.rlike(f"^(?:{BASE[kind]})$") & valid(kind, span), F.lit(k)) for k, kind in enumerate(KINDS)])


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, base, spans) of every row: arrays of (kind, start, end), kind 0 to 3 as in KINDS, in that order, then by start.

    base holds the base patterns' valid matches; spans those and the discovered ones, which never overlap a base span.
    Offsets are code points, end exclusive, over the whole text; a null or empty text has none. Repeated rows and null
    keys come out as often as they came in; other columns are dropped; an empty table gives no rows.
    """
    scanned = scan(docs, key, text)
    extra = discover(scanned, **options)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    own = scanned.join(extra, "digest", "left")
    both = F.array_sort(F.concat(plain, F.coalesce(F.col("extra"), F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return own.select(F.col("key").alias(key), plain.alias("base"), both.alias("spans"))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with every span of text replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans go as the first.

    All columns, whatever their names, keep name, type and order; a null text stays null. Only the discovered spans are
    joined, by the text's digest; they are broadcast only if Spark finds them small.
    """
    extra = discover(scan(docs, None, text), **options)
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("digest")).join(extra, "digest", "left")
    t = F.col("row")[text]
    spans = F.concat(F.transform(base_spans(t), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.transform(F.coalesce(F.col("extra"), F.array().cast("array<struct<kind:int,start:int,end:int>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(marks, s["kind"] + 1)).alias("out")),
    ).otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out")))
    clean = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    new = F.when(t.isNotNull(), clean)
    return whole.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in names])
