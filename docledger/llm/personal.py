"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans: those of the four base kinds, which always stay, and looser ones (addresses spelled with at and dot or with
spaces around the sign, cards grouped by dots, strokes or dashes, telephone numbers without a country code). Six labelers vote on each span for, against or not at all: the strict shape, the
validity rule, gazetteers (top-level domains, card issuers, calling codes, address ranges), words before the span, what touches
it, and placeholders. Expectation-maximisation over the counts of vote patterns estimates how each labeler votes on true and
false spans. Its posteriors then train a logistic classifier on features of the span and its surroundings, which decides the
loose spans. Vote and feature patterns are few whatever the corpus: Spark counts them, and both fits run on the counts, a few hundred
numbers of which there cannot be more than the votes and features combine to.

Places come from the texts between matches: their lengths add up, so a text with very many matches takes linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.rows import numbered
from docledger.session import keep

KINDS = ("email", "ip", "card", "phone")
#: Each starts where a run starts or the last match ended and never gives characters back, so that no run is tried twice.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++|(?: @ ?|@ )[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "card": r"(?<![0-9A-Za-z._/–·])[0-9]{4}([._/–·])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])(?![._/–·][0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TLDS = "com org net edu gov io info biz eu uk de fr es it nl ch at be pt us ca au jp cn in br mx test example".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CALLING = r"^\+ ?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])"
FOR = {"email": "mail|contact|write|reach|address", "ip": r"\bip\b|host|server|addr|login", "card": "card|visa|master|amex|credit|debit|pay", "phone": r"phone|tel|call|mobile|fax|ring|\bsms\b"}
AGAINST = {"email": "commit|sha|path", "ip": "version|section|release|chapter|build", "card": "order|isbn|serial|tracking|invoice|sku", "phone": "order|isbn|serial|version|part|article|sku|score"}
VOTES = ("shape", "valid", "listed", "before", "touching", "placeholder")
FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "loose", "long", "spaced", "word_before", "word_after", "cue", "valid", "listed")
TURNS, STEPS, RATE = 12, 300, 2.0
SURE = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True for strings of 13 to 19 digits that pass the check; others are not looked at."""
    n = F.char_length(digits)
    def worth(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _spelled(text: Column) -> Column:
    """Whether a text has a part that an address spelled with at and dot may be made of."""
    return text.contains("(at)") | text.contains("[at]") | text.contains(" dot ") | text.contains("(dot)") | text.contains("[dot]")


def guards(text: Column) -> dict[tuple[str, bool], Column]:
    """By kind and loose or not, a cheap condition that holds for every text in which the pattern matches."""
    digit = text.rlike("[0-9]")
    return {
        ("email", False): text.contains("@"),
        ("ip", False): digit & text.rlike(r"[0-9]\.[0-9]"),
        ("card", False): digit & text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        ("phone", False): text.contains("+") & digit,
        ("email", True): _spelled(text) | text.contains(" @") | text.contains("@ "),
        ("card", True): digit & text.rlike("[0-9]{4}[._/–·][0-9]{4}[._/–·][0-9]{4}"),
        ("phone", True): digit & text.rlike(r"[0-9][ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    }


def candidates(rows: DataFrame) -> DataFrame:
    """(rid, kind, loose, match, start, end, left, right) of every match in rows (rid, text); left and right are short."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    tries = []
    for (kind, loose), when in guards(text).items():
        p = F.lit((LOOSE if loose else BASE)[kind])
        found, between = F.regexp_extract_all("text", p, F.lit(0)), F.split("text", p, F.lit(-1))
        tries.append(F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), F.when(when, found).otherwise(none).alias("found"), F.when(when, between).otherwise(none).alias("between")))
    some = rows.filter(text.rlike("[0-9]") | text.contains("@") | _spelled(text))
    each = some.select("rid", F.explode(F.array(*tries)).alias("t")).filter(F.size("t.found") > 0)
    zipped = F.arrays_zip(F.col("t.found").alias("match"), F.col("t.between").alias("gap"), F.slice("t.between", F.lit(2), F.size("t.between")).alias("next"))
    each = each.select("rid", "t.kind", "t.loose", F.posexplode(zipped).alias("at", "z")).filter(F.col("z.match").isNotNull())
    each = each.select(
        "rid", "kind", "loose", "at", "z.match", F.char_length("z.gap").alias("gap"), F.char_length("z.match").alias("size"), F.right("z.gap", F.lit(32)).alias("left"), F.left("z.next", F.lit(8)).alias("right")
    )
    order = Window.partitionBy("rid", "kind", "loose").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(order).cast("long")
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).drop("at", "gap", "size")


def _by_kind(cases: dict[str, Column], other: Column) -> Column:
    out = None
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out.otherwise(other)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def judged(found: DataFrame) -> DataFrame:
    """The candidates with base (passes the base rule), votes and features."""
    m, left, right = F.col("match"), F.lower("left"), F.col("right")
    digits = _digits(m)
    n = F.char_length(digits)
    plain = F.regexp_replace(F.regexp_replace(m, r" ?(?:\(at\)|\[at\]| at |@) ?", "@"), r" ?(?:\(dot\)|\[dot\]| dot ) ?", ".")
    valid = _by_kind({"email": F.lit(True), "ip": m.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"), "card": _luhn(digits)}, n.between(9, 15))
    shape = _by_kind({"email": plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), "ip": ~m.rlike(r"(^|\.)0[0-9]"), "card": m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:([ ._/–·-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{5}))$")}, n.between(9, 13))
    first = F.split_part(m, F.lit("."), F.lit(1))
    listed = _by_kind(
        {"email": F.lower(F.substring_index(plain, ".", -1)).isin(TLDS), "ip": (F.char_length(first) <= 3) & first.cast("int").between(1, 223), "card": digits.rlike(ISSUERS)}, m.rlike(CALLING)
    )
    cue = _by_kind({k: left.rlike(x) for k, x in FOR.items()}, F.lit(False))
    against = _by_kind({k: left.rlike(x) for k, x in AGAINST.items()}, F.lit(False))
    touches = left.rlike(r"[\p{L}0-9_/=#]$") | right.rlike(r"^[\p{L}0-9_/=]")
    holder = digits.rlike(r"^(\d)\1{6,}$") | digits.rlike("12345678") | F.lower(plain).rlike(r"^(?:noreply|no-reply|user|name|foo)@")
    judged = found.withColumn("base", ~F.col("loose") & F.coalesce(valid, F.lit(False)))
    flags = {"shape": _vote(shape, ~shape), "valid": _vote(valid, ~valid), "listed": _vote(listed, ~listed), "before": _vote(cue, against), "touching": _vote(F.lit(False), touches), "placeholder": _vote(F.lit(False), holder)}
    whole = F.char_length(m)
    features = {f"is_{k}": (F.col("kind") == k) for k in KINDS} | {
        "long": whole > 16,
        "spaced": m.rlike("[ ().-]"),
        "word_before": left.rlike(r"[\p{L}0-9]\s*$"),
        "word_after": right.rlike(r"^\s*[\p{L}0-9]"),
        "cue": cue,
        "valid": valid,
        "listed": listed,
    }
    return judged.select("*", *[F.coalesce(v, F.lit(0)).alias(f"v_{k}") for k, v in flags.items()], *[F.coalesce(v, F.lit(False)).cast("int").alias(f"f_{k}") for k, v in features.items()], F.col("loose").cast("int").alias("f_loose"))


def _log_odds(row: dict, prior: float, rates: dict) -> float:
    """Log odds that a span is true, of its votes; rates[labeler][vote] = (rate on true, rate on false)."""
    return math.log(prior / (1 - prior)) + sum(math.log(rates[k][row[f"v_{k}"]][0] / rates[k][row[f"v_{k}"]][1]) for k in VOTES)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def estimate(patterns: list[dict]) -> tuple[float, dict]:
    """EM over counted vote patterns: the share of true spans, and each labeler's rates of votes on true and false ones."""
    prior, rates = 0.7, {k: {1: (0.6, 0.2), 0: (0.3, 0.3), -1: (0.1, 0.5)} for k in VOTES}
    for _ in range(TURNS):
        true = [(r, r["count"], r["count"] * _logistic(_log_odds(r, prior, rates))) for r in patterns]
        t = sum(q for *_, q in true)
        f = sum(n - q for _, n, q in true)
        prior = (t + 1) / (t + f + 2)
        told = {k: {v: [1.0, 1.0] for v in (1, 0, -1)} for k in VOTES}
        for r, n, q in true:
            for k in VOTES:
                told[k][r[f"v_{k}"]][0] += q
                told[k][r[f"v_{k}"]][1] += n - q
        rates = {k: {v: (a / (t + 3), b / (f + 3)) for v, (a, b) in told[k].items()} for k in VOTES}
    return prior, rates


def train(patterns: list[dict], prior: float, rates: dict) -> list[float]:
    """Weights of a logistic classifier on the features, the last its bias, fitted to the posteriors."""
    weights = [0.0] * (len(FEATURES) + 1)
    rows = [([i for i, k in enumerate(FEATURES) if r[f"f_{k}"]], r["count"], _logistic(_log_odds(r, prior, rates))) for r in patterns]
    total = sum(n for _, n, _ in rows)
    for _ in range(STEPS if rows else 0):
        steps = [0.0] * len(weights)
        for on, n, q in rows:
            off = n * (_logistic(weights[-1] + sum(weights[i] for i in on)) - q)
            steps[-1] += off
            for i in on:
                steps[i] += off
        weights = [w - RATE * (g / total + 1e-4 * w) for w, g in zip(weights, steps, strict=True)]
    return weights


def _score(weights: list[float]) -> Column:
    total = F.lit(weights[-1])
    for k, w in zip(FEATURES, weights, strict=False):
        total = total + F.lit(w) * F.col(f"f_{k}")
    return 1 / (1 + F.exp(-total))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row: spans are (kind, start, end, base, score) in the order of KINDS and start, in code points.

    Base spans follow the base rules alone; others are loose candidates that the trained classifier takes for true and that
    overlap no base span. Null and empty texts have none. Repeated rows each give a row; null keys stay; other columns are not
    read.
    """
    return _found(numbered(docs, key=F.col(key), text=F.col(text))).select(F.col("key").alias(key), "spans")


def _found(rows: DataFrame) -> DataFrame:
    votes, features = [f"v_{k}" for k in VOTES], [f"f_{k}" for k in FEATURES]
    spans = keep(judged(candidates(rows.select("rid", "text"))).select("rid", "kind", "loose", "start", "end", "base", *votes, *features), "candidates")
    patterns = [r.asDict() for r in spans.groupBy(*votes, *features).count().orderBy(*votes, *features).collect()]
    prior, rates = estimate(patterns)
    spans = spans.withColumn("score", _score(train(patterns, prior, rates))).filter(F.col("base") | (F.col("loose") & (F.col("score") >= SURE)))
    order = Window.partitionBy("rid").orderBy("start", "end")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("ends", ends).withColumn("starts", starts)
    apart = (F.coalesce("ends", F.lit(-1)) <= F.col("start")) & (F.coalesce("starts", F.col("end")) >= F.col("end"))
    spans = spans.filter(F.col("base") | apart)
    place = _by_kind({k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(len(KINDS)))
    listed = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base", "score"))).alias("found"))
    plain = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    listed = keep(listed.select("rid", plain.alias("spans")), "spans")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>")
    return rows.select("rid", "key").join(listed, "rid", "left").select("rid", "key", F.coalesce("spans", empty).alias("spans"))


def _replaced(text: Column, hits: Column) -> Column:
    """The text with its hits (start, end, kind; in order and apart) put as [kind]. Hits are taken in groups of about the root of their
    number: each group's stretch is cut out of the text once, and its hits are cut out of the stretch."""
    n = F.size(hits)
    group = F.ceil(F.sqrt(n)).cast("int")

    def stretch(first: Column) -> Column:
        start = F.when(first == 0, F.lit(0)).otherwise(F.try_element_at(hits, first)["end"].cast("int"))
        end = F.element_at(hits, F.least(first + group, n))["end"].cast("int")
        return F.struct(F.substring(text, start + 1, end - start).alias("part"), start.alias("start"), F.slice(hits, first + 1, group).alias("hits"))

    def put(p: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            last = F.when(i == 0, p["start"]).otherwise(F.try_element_at(p["hits"], i)["end"].cast("int"))
            return F.concat(F.substring(p["part"], last - p["start"] + 1, h["start"].cast("int") - last), F.lit("["), h["kind"], F.lit("]"))

        return F.array_join(F.transform(p["hits"], one), "")

    stretches = F.transform(F.sequence(F.lit(0), n - 1, group), stretch)
    rest = F.substring(text, F.element_at(hits, -1)["end"].cast("int") + 1, F.char_length(text))
    return F.concat(F.array_join(F.transform(stretches, put), ""), rest)


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with every span of text put as [kind]; overlapping spans are masked as the first of them. Null texts
    stay null, texts without spans and empty ones stay as they are; repeated rows each give a row; null keys stay."""
    others = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    rows = numbered(docs, key=F.col(key), text=F.col(text), **others)
    hit = _found(rows.select("rid", "key", "text")).filter(F.size("spans") > 0).select("rid", F.explode("spans").alias("s")).select("rid", "s.kind", "s.start", "s.end")
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("start") >= F.col("reach")) | (F.col("end") > F.col("reach")))
    hit = hit.withColumn("start", F.greatest("start", F.coalesce("reach", F.lit(0)))).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("hits"))
    joined = rows.join(keep(hit, "hits"), "rid", "left")
    masked = F.when(F.col("hits").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("hits")))
    return joined.select(*[(masked if c == text else F.col(n)).alias(c) for n, c in zip(others, docs.columns, strict=True)])
