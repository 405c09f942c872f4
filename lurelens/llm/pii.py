"""Personal data by weak supervision, with DataFrame functions only.

Base patterns and looser ones propose spans. Labelers (a strict pattern, a gazetteer of words around the span, a gazetteer of
parts of the span, its neighbouring characters, the variety of its digits) vote for, against or not at all. Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is; its posteriors are the soft labels on
which a naive Bayes span classifier is trained. Base spans stay; looser spans stay if the classifier is for them.

Places are code points, ends exclusive. Null and empty texts hold no spans. Rows are independent of each other but for the
counts, which cover all of them, repeated rows included; without candidates nothing is added. Other columns are left as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import text_of

#: Base kinds, in the order that breaks ties of places. Equal to the plain forms: possessive where no other length can match, and started only where a run starts.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Looser kinds: name, the whole form.
LOOSE = (
    ("dialled_phone", r"\+[0-9]{1,3}(?: ?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:[ .-][0-9]{2,4}){3,4})(?![0-9])"),
    ("local_phone", r"(?<![0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    ("number", r"(?<![0-9A-Za-z.-])[0-9]{9,13}(?![0-9A-Za-z.-])"),
)
KINDS = BASE + tuple(k for k, _ in LOOSE)
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|karte|carte|tarjeta|payment",
    "dialled_phone": "phone|call|tel|mobile|fax|contact|anruf", "phone": "phone|call|tel|mobile|fax|contact|anruf", "local_phone": "phone|call|tel|mobile|fax|contact|anruf", "national_id": r"\bssn\b|social|security|passport|identity",
    "account": "iban|account|bank|konto|compte|cuenta", "number": "phone|tel|account|konto|passport|customer|patient|iban",
}
AGAINST = r"version|isbn|issue|serial|token|hash|order|build|commit|page"
_SPAN = "array<struct<kind:string,first:int,last:int,match:string>>"
LABELERS = 5
LEFT = 32


def _all(text: Column, pattern: str, kind: Column | str, guard: Column) -> Column:
    """Every match with its place: the stretches between the matches give the places."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(held: Column, pair: Column) -> Column:
        first = held["at"] + F.length(pair["g"])
        last = first + F.length(pair["m"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), pair["m"].alias("match"))
        return F.when(pair["m"].isNull(), held).otherwise(F.struct(last.alias("at"), F.concat(held["out"], F.array(span)).alias("out")))

    return F.when(guard, F.aggregate(pairs, start, step, lambda held: held["out"])).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def _vote(against: Column, favour: Column) -> Column:
    """0 against, 1 none, 2 for."""
    return F.when(against, 0).when(favour, 2).otherwise(1)


def _votes(span: Column, text: Column) -> Column:
    kind, match, digits = span["kind"], span["match"], _digits(span["match"])
    left = F.lower(F.substring(text, F.greatest(span["first"] - LEFT + 1, F.lit(1)), F.least(F.lit(LEFT), span["first"])))
    before = F.when(span["first"] > 0, F.substring(text, span["first"], F.lit(1))).otherwise(F.lit(" "))
    after = F.substring(text, span["last"] + 1, F.lit(1))
    strict = (
        F.when(kind == "email", match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,18}$"))
        .when(kind == "ip", ~match.rlike(r"(^|\.)0[0-9]"))
        .when(kind == "card", digits.rlike("^[2-6]") & (F.length(digits) >= 15))
        .when(kind == "phone", match.rlike(r"^\+[1-9]"))
        .when(kind == "dialled_phone", match.rlike(r"^\+[1-9]") & F.length(digits).between(10, 15))
        .when(kind == "local_phone", match.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"))
        .when(kind == "national_id", ~match.rlike(r"^(000|666|9)|-00-|-0000$"))
        .when(kind == "account", (F.length(F.regexp_replace(match, " ", "")) >= 15))
        .otherwise(F.lit(False))
    )
    around = F.lit(False)
    for name, words in FOR.items():
        around = around | ((kind == name) & left.rlike(words))
    known = F.when(kind == "email", match.rlike(r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|eu|uk)$")).when(kind == "card", digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)")).otherwise(F.lit(False))
    joined = before.rlike(r"[A-Za-z0-9_=/\"'.#-]") | after.rlike(r"[A-Za-z0-9_=/\"'-]")
    variety = F.size(F.array_distinct(F.split(digits, "")))
    return F.array(
        _vote(~strict, strict), _vote(left.rlike(AGAINST), around), _vote(F.lit(False), known),
        _vote(joined, ~joined & before.rlike(r"[\s(:,;<]")), _vote((F.length(digits) >= 8) & (variety <= 2), (F.length(digits) >= 8) & (variety >= 5)),
    )


def candidate_column(text: Column) -> Column:
    """All spans, base ones that pass their checks and looser ones, by place: kind, first, last, base, votes, features."""
    some = text.rlike("[0-9]")
    email = _all(text, EMAIL, "email", F.instr(text, "@") > 0)
    ip = F.filter(_all(text, IP, "ip", some), lambda s: F.forall(F.split(s["match"], r"\."), _byte))
    card = F.filter(_all(text, CARD, "card", some), lambda s: F.length(_digits(s["match"])).between(14, 19) & F.when(F.length(_digits(s["match"])).between(14, 19), _luhn(_digits(s["match"]))).otherwise(F.lit(False)))
    phone = F.filter(_all(text, PHONE, "phone", F.instr(text, "+") > 0), lambda s: F.length(_digits(s["match"])).between(10, 15))
    base = F.concat(email, ip, card, phone)
    loose = F.concat(*[_all(text, pattern, kind, some) for kind, pattern in LOOSE])
    over = lambda a, b: (b["first"] < a["last"]) & (a["first"] < b["last"])
    rank = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(LOOSE) for x in (k, i)])
    # A looser span gives way to base spans and to spans of earlier looser kinds.
    free = F.filter(loose, lambda s: ~F.exists(base, lambda b: over(s, b)) & ~F.exists(loose, lambda b: over(s, b) & (rank[b["kind"]] < rank[s["kind"]])))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    described = lambda s: F.struct(
        s["first"].alias("first"), number[s["kind"]].alias("order"), s["last"].alias("last"), s["kind"].alias("kind"), s["kind"].isin(*BASE).alias("base"), _votes(s, text).alias("votes"),
        F.array(
            F.concat(s["kind"], F.lit("|length|"), F.least((s["last"] - s["first"]) / 4, F.lit(12)).cast("int").cast("string")),
            F.concat(s["kind"], F.lit("|digits|"), F.least(F.length(_digits(s["match"])), F.lit(20)).cast("string")),
            F.concat(s["kind"], F.lit("|variety|"), F.size(F.array_distinct(F.split(_digits(s["match"]), ""))).cast("string")),
        ).alias("features"))
    return F.array_sort(F.transform(F.concat(base, free), described))


def with_candidates(docs: DataFrame, text_col: str = "text", out: str = "__spans") -> DataFrame:
    return docs.withColumn(out, F.when(text_of(text_col).rlike("[0-9@]"), candidate_column(text_of(text_col))))


#: EM over vote patterns, as one expression: p holds the share of true spans and each labeler's vote probabilities for true and false ones.
_EM = """
aggregate(sequence(1, {rounds}),
  named_struct('prior', 0.5D, 't', array({good}), 'f', array({bad})),
  (p, i) -> aggregate(
    array(transform(patterns, x -> named_struct('n', x.n, 'v', x.v, 'q',
      (p.prior * aggregate(sequence(0, {last}), 1D, (a, l) -> a * p.t[l * 3 + x.v[l]]))
      / (p.prior * aggregate(sequence(0, {last}), 1D, (a, l) -> a * p.t[l * 3 + x.v[l]])
         + (1D - p.prior) * aggregate(sequence(0, {last}), 1D, (a, l) -> a * p.f[l * 3 + x.v[l]]))))),
    p,
    (old, w) -> named_struct(
      'prior', (1D + aggregate(w, 0D, (a, x) -> a + x.n * x.q)) / (2D + aggregate(w, 0D, (a, x) -> a + x.n)),
      't', transform(sequence(0, {cells}), c -> (old.t[c] + aggregate(w, 0D, (a, x) -> a + if(x.v[cast(floor(c / 3) as int)] = c % 3, x.n * x.q, 0D))) / (1D + aggregate(w, 0D, (a, x) -> a + x.n * x.q))),
      'f', transform(sequence(0, {cells}), c -> (old.f[c] + aggregate(w, 0D, (a, x) -> a + if(x.v[cast(floor(c / 3) as int)] = c % 3, x.n * (1D - x.q), 0D))) / (1D + aggregate(w, 0D, (a, x) -> a + x.n * (1D - x.q)))))))
"""


def reliabilities(patterns: DataFrame, rounds: int = 30) -> DataFrame:
    """One row (prior, t, f) from counts (votes, n) of vote patterns; there are at most 3 ** LABELERS of them, whatever the input."""
    good, bad = (", ".join(f"{x}D" for x in row * LABELERS) for row in ((0.15, 0.35, 0.5), (0.5, 0.35, 0.15)))
    one = patterns.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.col("votes").alias("v"))).alias("patterns"))
    return one.select(F.expr(_EM.format(rounds=rounds, good=good, bad=bad, last=LABELERS - 1, cells=3 * LABELERS - 1)).alias("p")).select("p.*")


class SpanModel:
    """Log odds by feature, and the prior; a few hundred numbers, as features are kinds with small buckets."""

    def __init__(self, prior: float, odds: dict[str, float], votes: tuple = ()):
        self.prior, self.odds, self.votes = prior, odds, votes

    def keeps(self, span: Column) -> Column:
        """Base spans, and those the classifier finds likelier than not."""
        if not self.odds:
            return span["base"]
        table = F.create_map(*[F.lit(x) for k, v in sorted(self.odds.items()) for x in (k, v)])
        odds = F.aggregate(span["features"], F.lit(float(self.prior)), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return span["base"] | (odds > 0)


def fit(spans: DataFrame, column: str = "__spans") -> SpanModel:
    """EM on the counts of vote patterns, then naive Bayes on the posteriors as soft labels."""
    counts = spans.select(F.explode(column).alias("s")).groupBy(F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count("*").alias("n")).persist()
    try:
        if counts.isEmpty():
            return SpanModel(0.0, {})
        p = reliabilities(counts.groupBy("votes").agg(F.sum("n").alias("n"))).first()
        side = lambda share, table: F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.lit(share), lambda a, i: a * F.array(*map(F.lit, table))[i * 3 + F.col("votes")[i]])
        soft = counts.withColumn("q", side(p.prior, p.t) / (side(p.prior, p.t) + side(1 - p.prior, p.f)))
        total = soft.agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).first()
        rows = soft.select(F.explode("features").alias("feature"), "n", "q").groupBy("feature").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    finally:
        counts.unpersist()
    prior = math.log((total.yes + 1) / (total.no + 1))
    odds = {r.feature: math.log((r.yes + 0.5) / (total.yes + 20)) - math.log((r.no + 0.5) / (total.no + 20)) for r in rows}
    return SpanModel(prior, odds, (p.prior, p.t, p.f))


def found(model: SpanModel, column: str = "__spans") -> Column:
    """The spans that stay, by place, then kind."""
    empty = "array<struct<first:int,order:int,last:int,kind:string,base:boolean,votes:array<int>,features:array<string>>>"
    return F.filter(F.coalesce(F.col(column), F.array().cast(empty)), model.keeps)


def digest(spans: DataFrame, model: SpanModel, id_col: str = "doc_id", column: str = "__spans") -> DataFrame:
    """Counts of base kinds, digest of base spans, all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = spans.select(id_col, found(model, column).alias("own"))
    return own.select(
        id_col, *map(count, BASE),
        F.sha2(joined(F.filter("own", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("own")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    def step(held: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(held["parts"], F.array(F.substring(text, held["at"] + 1, s["first"] - held["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"), s["last"].alias("at"))
        return F.when(s["first"] >= held["at"], fresh).otherwise(F.struct(held["parts"].alias("parts"), F.greatest(held["at"], s["last"]).alias("at")))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda held: F.array_join(F.concat(held["parts"], F.array(F.substring(text, held["at"] + 1, F.length(text)))), "")))


def mask_documents(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The documents with personal data masked and n_chars counted anew; columns as they were."""
    spans = with_candidates(docs).withColumn("__spans", found(model))
    out = spans.withColumn("text", masked(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
