"""Secrets found with a trigram inverted index, in DataFrame functions alone.

From the regex of each rule follows which trigrams every match must hold: a choice of sets, of one
of which all must occur. The index lists, for every trigram that the rules ask for, the documents
that hold it, letters in lower case. Intersecting the lists of a set gives its candidates, and only
these are searched by the regex. Rules without mandatory trigrams search every document.

Spans count code points, end exclusive: the texts between the matches of a rule and the matches
themselves add up to the places.

Defined cases: null and empty texts hold nothing. Rows with the same id and text are looked up
once and each get the result. Matches of one rule do not overlap; matches of different rules may.
Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.arrows import checkpointed, keyed, quoted

CHOICES = 256  # beyond, a part of a regex counts as unknown


@dataclass(frozen=True)
class Rule:
    """Matches of a regex, of which those stay whose group has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# Patterns of secrets.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

_GAP = None


def _fragments(parsed) -> list[tuple]:
    """All ways through a parsed regex, each as known texts with gaps between them."""
    ways: list[tuple] = [()]
    for op, value in parsed:
        if op is sre.LITERAL:
            own = [(chr(value).lower(),)]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            own = [(chr(v).lower(),) for _, v in value]
        elif op is sre.BRANCH:
            own = [w for branch in value[1] for w in _fragments(branch)]
        elif op is sre.SUBPATTERN:
            own = _fragments(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            own = _fragments(inner) if least or most == 1 else [(_GAP,)]
            if most > 1 and least:
                own = [(*w, _GAP) for w in own]
            if not least and most == 1:
                own = [(), *own]
        else:
            own = [(_GAP,)]
        own = list(dict.fromkeys(own))
        if len(ways) * len(own) > CHOICES:
            own = [(_GAP,)]
        ways = [(*w, *o) for w in ways for o in own]
    return ways


def trigrams(regex: str) -> list[frozenset[str]]:
    """Sets of trigrams, in lower case: every match holds all of at least one set.

    None where some match need not hold any trigram.
    """
    sets = set()
    for way in _fragments(_parser.parse(regex)):
        known = "".join("\n" if f is _GAP else f for f in way).split("\n")
        sets.add(frozenset(k[i : i + 3] for k in known for i in range(len(k) - 2)))
    least = [s for s in sets if not any(o < s for o in sets)]
    return [] if frozenset() in least else sorted(least, key=sorted)


def index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index of keyed documents for some trigrams: (trigram, k1, k2)."""
    low = docs.select("k1", "k2", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))
    return low.select("k1", "k2", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, kinds): the documents that may hold matches of the rules with mandatory trigrams."""
    asked = [
        (rule.kind, choice, t, len(needed))
        for rule in rules
        for choice, needed in enumerate(trigrams(rule.regex))
        for t in sorted(needed)
    ]
    spark = docs.sparkSession
    if not asked:
        return docs.select("k1", "k2", F.array().cast("array<string>").alias("kinds")).limit(0)
    asks = spark.createDataFrame(asked, "kind string, choice int, trigram string, needed int")
    postings = index(docs, sorted({t for _, _, t, _ in asked}))
    return (
        # one row for each trigram of each rule, however many documents there are
        postings.join(F.broadcast(asks), "trigram")
        .groupBy("k1", "k2", "kind", "choice", "needed")
        .agg(F.count("*").alias("held"))
        .where("held = needed")
        .groupBy("k1", "k2")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per match: k1, k2 (hashes of id and text), rule (its number), kind, start, end."""
    rows = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    return _spans(keyed(rows, "id", "text"), rules)


def _spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    rows = rows.where("text is not null").select("k1", "k2", "text")
    known = checkpointed(candidates(rows, rules))
    searched = rows.join(known, ["k1", "k2"], "left")
    found = []
    for rule in rules:
        may = F.array_contains("kinds", rule.kind) if trigrams(rule.regex) else F.lit(True)
        found.append(
            F.when(
                F.when(may, F.col("text").rlike(rule.regex)).otherwise(False),
                F.arrays_zip(
                    F.transform(F.split("text", rule.regex, -1), F.char_length).alias("gap"),
                    F.transform(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)), F.char_length).alias("length"),
                    F.transform(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)), F.char_length).alias("group"),
                ),
            ).alias(rule.kind)
        )
    hits = searched.select("k1", "k2", *found).distinct()
    per_rule = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(r.kind).alias("parts")) for n, r in enumerate(rules)))
    parts = hits.select("k1", "k2", F.explode(per_rule).alias("r")).select("k1", "k2", "r.rule", F.posexplode("r.parts").alias("at", "p"))
    order = Window.partitionBy("k1", "k2", "rule").orderBy("at")
    before = F.coalesce(F.sum(F.col("p.gap") + F.coalesce("p.length", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("k1", "k2", "rule", "p", (before + F.col("p.gap")).alias("start")).where("p.length is not null")
    kind = F.array(*(F.lit(r.kind) for r in rules))[F.col("rule")]
    least = F.array(*(F.lit(r.least) for r in rules))[F.col("rule")]
    return placed.where(F.col("p.group") >= least).select(
        "k1", "k2", "rule", kind.alias("kind"), "start", (F.col("start") + F.col("p.length")).alias("end")
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, spans (array of start, rule, kind, end; by start, then rule)."""
    rows = keyed(docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text")), "id", "text")
    per_doc = checkpointed(
        _spans(rows, rules)
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rule", "kind", "end"))).alias("spans"))
    )
    out = rows.select("id", "k1", "k2").join(per_doc, ["k1", "k2"], "left")
    empty = F.array().cast("array<struct<start:bigint,rule:int,kind:string,end:bigint>>")
    return out.select(F.col("id").alias(id), F.coalesce("spans", empty).alias("spans"))
