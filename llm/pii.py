"""Personal data: generators propose spans, boosted trees and calibrated thresholds select them.

Per kind, a strict generator finds well-formed data (checked by digits, octets or Luhn) and
these spans stay. Wider generators propose looser forms, which may overlap them. Every
candidate gets features of its format and its context; boosted trees are fitted on the strict
generators' candidates, which their checks label, without the features that those checks read
alone, and a looser candidate is selected if its score reaches its kind's threshold, the least
at which held-out candidates are right as often as ``PRECISION``.

All of it is columns of one row: candidates are an array, the trees a CASE expression over it,
so texts are not shuffled and nothing leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
# fixed values: the strict patterns, written so that no text makes them backtrack far. A match of
# the plain pattern starts where a run of its first class starts, or where the last match ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}[\x20]?\.[\x20]?){3}[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[.\x20/-]){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
HINT = {"email": r"(?i)mail|contact", "ip": r"(?i)\bip\b|addr|host", "card": r"(?i)card|visa|pay", "phone": r"(?i)tel|phone|call|fax"}
# what a text must hold for a pattern to be worth a search
NEEDS = {("email", 1): "@", ("email", 0): "at", ("ip", 1): ".", ("ip", 0): ".", ("phone", 1): "+"}
AROUND = 24  # code points of context on either side
TREES = 12
DEPTH = 3
PRECISION = 0.98
FEATURES = (
    "length", "digits", "letters", "signs", "groups", "longest", "line_start", "space_before", "digit_before",
    "sign_before", "space_after", "digit_after", "sign_after", "hint", "k_email", "k_ip", "k_card", "k_phone",
)


def _search(text: Column, kind: str, strict: bool) -> Column:
    """Matches with their places in code points, as an array."""
    pattern = (STRICT if strict else WIDE)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s).cast("long"))
    # ends of matches: lengths of what lies between and of the matches, added up in order
    sized = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    step = F.aggregate(
        sized,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<kind:int,strict:int,start:bigint,end:bigint,m:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.char_length(x["m"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.lit(KINDS.index(kind)).alias("kind"),
                        F.lit(int(strict)).alias("strict"),
                        (acc["at"] + x["gap"]).alias("start"),
                        (acc["at"] + x["gap"] + F.char_length(x["m"])).alias("end"),
                        x["m"].alias("m"),
                    )
                ),
            ).alias("out"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,strict:int,start:bigint,end:bigint,m:string>>")
    need = NEEDS.get((kind, int(strict)))
    worth = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
    return F.when(worth, step["out"]).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(c: Column) -> Column:
    """Whether a candidate passes the check of its kind."""
    digits = _digits(c["m"])
    n = F.char_length(digits)
    octets = F.split(c["m"], r"\.")
    return (
        F.when(c["kind"] == 0, F.lit(True))
        .when(c["kind"] == 1, F.forall(octets, lambda o: F.coalesce(o.try_cast("bigint") <= 255, F.lit(False))))
        .when(c["kind"] == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _features(text: Column, c: Column) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES."""
    m = c["m"]
    first = F.greatest(c["start"] - AROUND, F.lit(0))
    before = F.substring(text, (first + 1).cast("int"), (c["start"] - first).cast("int"))
    after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
    last = F.right(before, F.lit(1))
    groups = F.split(m, "[^0-9]+")
    hint = F.lit(False)
    for k, kind in enumerate(KINDS):
        hint = hint | ((c["kind"] == k) & before.rlike(HINT[kind]))
    made = [
        F.char_length(m),
        F.char_length(_digits(m)),
        F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")),
        F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        F.size(groups),
        F.array_max(F.transform(groups, lambda g: F.char_length(g))),
        (before == "") | before.endswith("\n"),
        last.rlike(r"\s"),
        last.rlike("[0-9]"),
        last.rlike(r"[^\sA-Za-z0-9]"),
        after.rlike(r"\s") | (after == ""),
        after.rlike("[0-9]"),
        after.rlike(r"[^\sA-Za-z0-9]"),
        hint,
        *(c["kind"] == k for k in range(len(KINDS))),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in made]


def candidates(text: Column) -> tuple[Column, Column]:
    """Checked spans of the strict generators, and all candidates with whether they pass."""
    strict = F.concat(*[_search(text, k, True) for k in KINDS])
    wide = F.concat(*[_search(text, k, False) for k in KINDS])
    return F.filter(strict, _valid), F.concat(strict, wide)


def tree_sql(dump: str, weights: list[float], cell: str = "f[{}]") -> str:
    """The sum of the trees of a model's text dump, weighted, as one SQL expression."""
    lines = [line.strip() for line in dump.splitlines()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"{float(line.split(':')[1])!r}D"
        rule = re.fullmatch(r"If \(feature (\d+) (<=|>) (\S+)\)", line)
        yes = node()
        at += 1  # the Else
        no = node()
        return f"CASE WHEN {cell.format(rule[1])} {rule[2]} {float(rule[3])!r}D THEN {yes} ELSE {no} END"

    parts = []
    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            parts.append(f"{float(weights[len(parts)])!r}D * ({node()})")
        else:
            at += 1
    return " + ".join(parts) or "0D"


def labelled_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every strict candidate of every text with its check's outcome, equal ones as one row.

    ``n`` says how many candidates a row stands for, ``held`` whether they are kept from the fit.
    """
    strict = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "t", F.concat(*[_search(F.col("t"), k, True) for k in KINDS]).alias("c")
    )
    rows = strict.select("t", F.explode("c").alias("c")).select(
        _valid(F.col("c")).cast("double").alias("label"), F.array(*_features(F.col("t"), F.col("c"))).alias("f"),
        F.col("c.kind").alias("kind"), (F.pmod(F.xxhash64("t", "c.start", "c.kind"), F.lit(4)) == 0).alias("held"),
    )
    return rows.groupBy("label", "kind", "held", "f").agg(F.count("*").cast("double").alias("n"))


def fit_selector(docs: DataFrame, text: str = "text") -> tuple[str, list[float]]:
    """The trees as SQL over the array ``f``, and a threshold for each kind.

    Fitted on all strict candidates but those held out, on which the thresholds are found. If all
    candidates have one outcome, nothing can be learnt and no looser candidate is selected.
    """
    found = cut(labelled_candidates(docs, text))
    outcomes = {r[0] for r in found.select("label").distinct().collect()}
    if len(outcomes) < 2:
        return "0D", [float("inf")] * len(KINDS)
    flat = found.where("NOT held").select("label", "n", *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(flat)
    model = GBTClassifier(
        labelCol="label", featuresCol="v", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=3
    ).fit(ready)
    sql = tree_sql(model.toDebugString, list(model.treeWeights))
    held = found.where("held").select("kind", "label", "n", F.expr(sql).alias("z"))
    cuts = [float("inf")] * len(KINDS)
    # sums by score: a model of TREES small trees has few distinct ones
    sums = held.groupBy("kind", F.round("z", 3).alias("z")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    for k in range(len(KINDS)):
        good = n = 0
        for r in sorted((r for r in sums if r["kind"] == k), key=lambda r: -r["z"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and r["z"] > 0:
                cuts[k] = r["z"]
    return sql, cuts


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``all`` spans: arrays of (start, kind, end), ordered, kind a number.

    Places are code points, end exclusive. Null text counts as empty; a row without data has
    empty arrays. Equal spans of one kind are listed once. Rows are looked at one by one, so
    repeated rows and ids do no harm.
    """
    sql, cuts = fit_selector(docs, text)
    names = [c for c in docs.columns if c not in ("base", "all")]
    whole = F.coalesce(F.col(text), F.lit(""))
    base, every = candidates(whole)
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    found = docs.select(*[F.col(f"`{c}`") for c in names], base.alias("_strict"), every.alias("_all"))
    wide = F.filter("_all", lambda c: c["strict"] == 0)
    if min(cuts) < float("inf"):
        scored = F.transform(wide, lambda c: F.struct(c.alias("c"), F.array(*_features(whole, c)).alias("f")))
        found = found.withColumn("_scored", scored)
        limits = ", ".join(f"{c!r}D" if c < float("inf") else "double('Infinity')" for c in cuts)
        chosen = F.expr(
            f"transform(filter(_scored, s -> ({re.sub(r'f\[', 's.f[', sql)}) >= element_at(array({limits}), s.c.kind + 1)), s -> s.c)"
        )
    else:
        chosen = F.filter(wide, lambda c: F.lit(False))
    return found.select(
        *names,
        F.array_sort(F.transform("_strict", span)).alias("base"),
        F.array_sort(F.array_distinct(F.concat(F.transform("_strict", span), F.transform(chosen, span)))).alias("all"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every stretch that spans cover replaced by the name of its first span's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    merged = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.element_at(names, s["kind"] + 1),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
    )
    with_tail = F.transform(
        F.array(merged), lambda m: F.concat(m["out"], F.substring(text, (m["at"] + 1).cast("int"), F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, with_tail[0]).otherwise(text)
