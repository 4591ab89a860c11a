"""Personal data by weak supervision, in DataFrame operations only.

1. Base spans: four patterns, leftmost and non-overlapping per kind, less those whose check fails.
   The patterns are written so that no text takes more than linear time: a run of letters is
   entered at its start only (or where the last match ended) and repeats are possessive, which
   changes no match.
2. Candidates: the base spans, and looser spans: spelled-out addresses, IPv6 addresses, telephone
   numbers without country code, numbers as long as a card's, whatever their check digit, numbers that a base pattern
   has lost because it ran on into the digits of a neighbour, and secrets (values named as one, long hexadecimal
   strings, well-known key prefixes).
3. Labelers vote for, against or not at all: pattern, form, check, gazetteer, context before, context that says
   otherwise, how the span is set off from its surroundings, and whether its document has other base spans.
4. For each kind, expectation-maximisation over the counts of vote patterns (at most 3 to the number of labelers)
   estimates how reliable each labeler is, how likely base and looser spans are personal data, and so each pattern.
5. A naive Bayes classifier of spans is trained on these likelihoods, over features of the span and
   its surroundings. Looser spans that it accepts with ``ACCEPT`` and that touch no base span are added.

Texts are scanned once and never shuffled; what follows works on spans with 40 characters of context.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4
ACCEPT = 0.9
ROUNDS = 25
BEFORE, AFTER = 40, 8

# The base patterns, in linear-time form.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a scan.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_NAMED = r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer)[\"']?(?: {0,2}[:=] {0,2}| )[\"']?"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[] ?dot ?[)\]]|\.) ?[A-Za-z0-9-]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{2,7}+|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\([0-9]{3}\) ?|(?<![0-9A-Za-z+.)-])\([0-9]{3}\) ?|(?<![0-9A-Za-z+.-])(?<![0-9] )[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+.-])(?<![0-9] )(?:0[1-9](?:[ .-][0-9]{2}){4}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}|0[1-9][0-9]{1,4}[ /-][0-9]{5,8})(?![0-9])",
    "secret": rf"(?<={_NAMED})[A-Za-z0-9+/_.=-]{{12,}}+|(?<![0-9A-Za-z])(?:[0-9a-f]{{32,64}}+|[0-9A-F]{{32,64}}+|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}})(?![0-9A-Za-z])",
}
LOOSE_HINT = {
    "email": r"[(\[] ?at ?[)\]]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": HINT["card"], "phone": r"[0-9]{3}[ .-][0-9]{4}|[0-9][ .-][0-9]{2}[ .-][0-9]{2}|0[1-9][0-9]{1,4}[ /-][0-9]{5}",
    "secret": rf"{_NAMED}[A-Za-z0-9+/_.=-]{{12}}|[0-9A-Fa-f]{{32}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}",
}

# Gazetteers and context words (English, German, French, Spanish).
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|kontakt|correo|courriel|write to|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|direcci[oó]n|login|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|telephone|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|fax|handy|anruf)\b",
    "secret": rf"{_NAMED}$",
}
SECRET_PREFIXES = ("AKIA", "ghp_", "gho_", "ghs_", "sk-", "xox", "eyJ")
OTHERWISE = r"(?i)\b(version|release|isbn|issn|order|invoice|serial|section|chapter|figure|sku|part|doi|build|nr|no|id)\b[ .:#]{0,3}$"


def _hits(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<gap, hit, before, after>> of the matches; ``gap`` is the number of code points since the one before."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Zipped first: what a lambda function refers to from outside is evaluated anew for each element.
    zipped = F.filter(F.arrays_zip(pieces, hits, F.slice(F.concat(pieces, F.array(F.lit(""))), 2, 1 << 30)), lambda x: x.getField("1").isNotNull())
    found = F.transform(zipped, lambda x: F.struct(
        F.length(x.getField("0")).alias("gap"), x.getField("1").alias("hit"),
        F.right(x.getField("0"), F.lit(BEFORE)).alias("before"), F.left(x.getField("2"), F.lit(AFTER)).alias("after"),
    ))
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<struct<gap:int,hit:string,before:string,after:string>>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _octet(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


CHECK = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _octet),
    "card": lambda x: luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}


def _candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): uid and doc_id of each row, and uid, kind, is_base, start, end, hit, before, after, company (other base spans of its row)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text.alias("text"))
    every = [F.struct(F.lit(k).alias("kind"), F.lit(True).alias("is_base"), _hits(F.col("text"), BASE[n], HINT[n]).alias("hits")) for k, n in enumerate(KINDS[:N_BASE])]
    every += [F.struct(F.lit(k).alias("kind"), F.lit(False).alias("is_base"), _hits(F.col("text"), LOOSE[n], LOOSE_HINT[n]).alias("hits")) for k, n in enumerate(KINDS)]
    rows = rows.select("uid", "doc_id", F.filter(F.array(*every), lambda x: F.size(x["hits"]) > 0).alias("found"))
    rows = C.materialise(rows, "pii-hits")
    hits = rows.select("uid", F.explode("found").alias("x")).select("uid", "x.kind", "x.is_base", F.posexplode("x.hits").alias("k", "h"))
    upto = Window.partitionBy("uid", "is_base", "kind").orderBy("k")
    end = F.sum(F.col("h.gap") + F.length("h.hit")).over(upto).cast("int")
    spans = hits.select("uid", "kind", "is_base", (end - F.length("h.hit")).alias("start"), end.alias("end"), "h.hit", "h.before", "h.after")
    checked = _by_kind({n: CHECK[n](F.col("hit")) for n in KINDS[:N_BASE]})
    spans = spans.filter(~F.col("is_base") | checked)
    # A looser span touches a base one that starts before its end and ends behind its start: one pass in the order of these.
    near = Window.partitionBy("uid").orderBy(F.when(F.col("is_base"), F.col("start")).otherwise(F.col("end")), F.col("is_base")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max(F.when(F.col("is_base"), F.col("end"))).over(near))
    spans = spans.withColumn("company", F.count(F.when(F.col("is_base"), 1)).over(Window.partitionBy("uid")) - F.col("is_base").cast("int"))
    spans = spans.filter(F.col("is_base") | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")
    return rows.select("uid", "doc_id"), C.materialise(spans, "pii-spans")


def _by_kind(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col("kind") == KINDS.index(k), v).otherwise(out)
    return out


LABELERS = ("pattern", "form", "check", "gazetteer", "context", "otherwise", "set off", "company")
N_LABELERS = len(LABELERS)


def votes(spans: DataFrame) -> DataFrame:
    """Adds ``v``, the labelers' votes: 1 for, -1 against, 0 none."""
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    d = _digits(hit)
    yes, sign = (lambda c: F.when(c, 1).otherwise(0)), (lambda c: F.when(c, 1).otherwise(-1))
    area = F.regexp_extract(F.regexp_replace(hit, r"^(\+|00)[0-9]{1,3}[ .-]|^0", ""), "([0-9])", 1)
    by_labeler = [
        yes(F.col("is_base")),
        _by_kind({
            "email": yes(hit.contains("@") | hit.rlike(r"[(\[] ?dot ?[)\]]")), "ip": yes(hit.rlike("^([0-9A-Fa-f]+:){7}")), "card": yes(F.length(d).isin(15, 16)),
            "phone": sign(F.length(d).between(9, 15)), "secret": yes(before.rlike(CONTEXT["secret"])),
        }),
        _by_kind({
            "email": F.lit(0), "ip": F.lit(0), "card": sign(luhn(d)), "phone": F.when(area.rlike("[2-9]"), 1).when(area.rlike("[01]"), -1).otherwise(0),
            "secret": sign(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.length(hit) >= 16)),
        }),
        _by_kind({
            "email": sign(F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS)), "ip": sign(~hit.rlike(r"^(0|255)\.")),
            "card": sign(reduce(lambda a, b: a | b, [d.startswith(p) for p in CARD_PREFIXES])), "phone": sign(~d.rlike(r"^(\d)\1+$")),
            "secret": yes(reduce(lambda a, b: a | b, [hit.startswith(p) for p in SECRET_PREFIXES])),
        }),
        yes(_by_kind({k: before.rlike(p) for k, p in CONTEXT.items()})),
        F.when(before.rlike(OTHERWISE), -1).otherwise(0),
        sign(before.rlike(r"(^|[\s(<\[\"':;,=])$") & after.rlike(r"^([^\p{L}\p{N}_]|$)")),
        yes(F.col("company") > 0),
    ]
    return spans.withColumn("v", F.array(*[x.cast("int") for x in by_labeler]))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


#: Spans that each labeler is taken to have seen besides, by its vote (against, none, for): of those that are personal
#: data, and in reverse of those that are not. More for patterns and checks.
PRIOR_VOTES = ((0.5, 3.0, 12.0), (1.0, 3.0, 4.0), (0.5, 3.0, 12.0), *[(1.0, 3.0, 4.0)] * 5)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind and w, from rows (kind, v, n): for each labeler the log odds that its vote against, none and for lends, and then
    the prior log odds of a looser and of a base span.

    For each kind, a labeler has rates of its votes among spans that are personal data and among those that are not, so
    one that votes for everything tells nothing. The first labeler tells base spans apart, which have a prior of their
    own. The whole iteration is one expression over the bounded array of a kind's patterns.
    """
    some = patterns.groupBy("kind").agg(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n"))).alias("ps"))
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    yes0 = [x for p in PRIOR_VOTES for x in p]
    no0 = [x for p in PRIOR_VOTES for x in reversed(p)]
    seen0 = [sum(p) for p in PRIOR_VOTES for _ in p]

    def step(w: Column) -> Column:
        q = F.transform(F.col("ps"), lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (p["n"] * likelihood(w, p["v"])).alias("q")))
        yes, all_n = F.aggregate(q, F.lit(0.0), lambda s, p: s + p["q"]), F.aggregate(q, F.lit(0.0), lambda s, p: s + p["n"])

        def lends(i: Column) -> Column:
            """Of vote i % 3 - 1 of labeler i / 3, both from 0."""
            mine = F.filter(q, lambda p: F.element_at(p["v"], F.floor(i / 3).cast("int") + 1) == (i % 3 - 1))
            of_yes = F.aggregate(mine, F.get(listed(yes0), i), lambda s, p: s + p["q"]) / (yes + F.get(listed(seen0), i))
            of_no = F.aggregate(mine, F.get(listed(no0), i), lambda s, p: s + p["n"] - p["q"]) / (all_n - yes + F.get(listed(seen0), i))
            return F.log(of_yes / of_no)

        def prior(base: int) -> Column:
            of = F.filter(q, lambda p: F.element_at(p["v"], 1) == base)
            return _logit(F.aggregate(of, F.lit(1.0), lambda s, p: s + p["q"]) / F.aggregate(of, F.lit(2.0), lambda s, p: s + p["n"]))

        return F.concat(F.transform(F.sequence(F.lit(0), F.lit(3 * N_LABELERS - 1)), lends), F.array(prior(0), prior(1)))

    # Each round is a projection of its own, so that expressions stay small.
    some = some.withColumn("w", listed([*(math.log(y / n) for y, n in zip(yes0, no0, strict=True)), 0.0, 0.0]))
    for k in range(rounds):
        some = some.select("kind", "ps", step(F.col("w")).alias("w"))
        if k % 5 == 4:
            some = C.materialise(some, "pii-em")
    return some.select("kind", "w")


def likelihood(w: Column, v: Column) -> Column:
    """Of a vote pattern under log odds ``w``."""
    start = F.element_at(w, F.lit(3 * N_LABELERS + 1) + F.element_at(v, 1))
    z = F.aggregate(F.sequence(F.lit(1), F.lit(N_LABELERS)), start, lambda s, j: s + F.element_at(w, j * 3 - 1 + F.element_at(v, j)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: Spans of unknown features that each kind is taken to have besides, half of them personal data.
SMOOTH = 0.1


def judged(spans: DataFrame) -> DataFrame:
    """The spans with ``q``, the labelers' likelihood, and ``p``, the classifier's."""
    each = C.materialise(votes(spans), "pii-votes")
    w = reliabilities(each.groupBy("kind", "v").agg(F.count("*").alias("n")))
    each = each.join(F.broadcast(w), "kind")  # one row for each of KINDS
    each = each.withColumn("q", likelihood(F.col("w"), F.col("v"))).drop("w")
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.left("hit", F.lit(64)), "[0-9]+", "9"), "[A-Za-z]+", "a"), "(9[^9]|a[^a]){3,}", "*")
    side = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), r"\p{L}", "a")
    of_kind = lambda name, *v: F.concat(F.col("kind"), F.lit(f" {name} "), *v)
    features = F.array(
        of_kind("size", F.least(F.floor(F.length("hit") / 4), F.lit(12))),
        of_kind("digits", F.least(F.length(_digits(F.col("hit"))), F.lit(20))),
        of_kind("form", F.left(form, F.lit(12))),
        of_kind("before", side(F.right("before", F.lit(1)))),
        of_kind("after", side(F.left("after", F.lit(1)))),
        *[of_kind(f"vote {j}", F.element_at("v", j + 1)) for j in range(1, N_LABELERS)],
    )
    each = C.materialise(each.withColumn("f", features), "pii-features")
    counts = each.select("kind", "q", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    odds = each.groupBy("kind").agg(((F.sum("q") + SMOOTH) / (F.count("*") + 2 * SMOOTH)).alias("share"))
    odds = C.materialise(odds.select("kind", "share", _logit(F.col("share")).alias("odds")), "pii-odds")  # one row for each of KINDS
    # A feature value is taken to be seen once more, as often with personal data as its kind, so that a rare one says little.
    # Values are few by their making, so this table has a bound: kinds x (13 + 21 + forms of 12 signs + sides + votes).
    gain = F.log((F.col("yes") + F.col("share")) / (F.col("no") + 1 - F.col("share"))) - F.col("odds")
    gains = counts.join(F.broadcast(odds), "kind").select("f", gain.alias("gain"))
    # Only looser spans are up for decision; the base ones stay.
    loose = each.filter(~F.col("is_base")).select("uid", "kind", "start", "end", "q", F.explode("f").alias("f"))
    z = loose.join(gains, "f").groupBy("uid", "kind", "start", "end", "q").agg(F.sum("gain").alias("z")).join(F.broadcast(odds.select("kind", "odds")), "kind")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z") - F.col("odds")))
    base = each.filter("is_base").select("uid", "kind", "start", "end", "is_base", "q", F.lit(1.0).alias("p"))
    return base.unionByName(z.select("uid", "kind", "start", "end", F.lit(False).alias("is_base"), "q", p.alias("p")))


def find_personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret.

    The four counts and the hash are of the base spans; ``spans`` lists these and the added ones as
    kind:start:end, ordered by start, then kind; ``n_secret`` of the added ones are secrets. Null and empty texts have none. Null ids and
    repeated rows stay rows of their own; an empty table gives no rows; extra columns are ignored.
    """
    rows, spans = _candidates(docs.select("doc_id", "text"))
    kept = judged(spans).filter(F.col("is_base") | ((F.col("p") >= accept) & (F.col("q") >= 0.5)))
    one = F.struct("start", "kind", "end", "is_base")
    found = kept.groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("all"))
    rows = rows.join(found, "uid", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,is_base:boolean>>")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])))

    def count(keep) -> Column:
        return F.size(F.filter("all", keep)).cast("long")

    def base_of(k: int):
        return lambda s: s["is_base"] & (s["kind"] == k)

    return rows.select(
        "doc_id",
        *[count(base_of(k)).alias(f"n_{n}") for k, n in enumerate(KINDS[:N_BASE])],
        F.sha2(written(F.filter("all", lambda s: s["is_base"])), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
        count(lambda s: ~s["is_base"]).alias("n_added"), count(lambda s: s["kind"] == KINDS.index("secret")).alias("n_secret"),
    )


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(C.table(spark, sf_dir, "documents"))
