"""Personal data by bootstrapped contextual extraction, in native expressions only.

Base entities (e-mail, IP, card and phone numbers in fixed formats) are the seeds. Every
token with digits or an ``@`` is a candidate, and so are groups of digits with single blanks
between them; of one that holds a base entity that entity itself, of one behind a ``label=``
the rest. The words around it and the label are its lexical patterns. Patterns and candidate strings form a graph:
a pattern's confidence in a kind is the share of its distinct strings trusted as that kind,
a string's trust comes from the confident patterns it stands in, and a few rounds of both
are joined and aggregated in Spark. Patterns that end confident, with enough different seeds
behind them, label the candidates in their slot that no base format matched.

Positions come from splitting the text at the matches and adding up lengths in code points.
The expressions are written so that matching takes time in proportion to the text: runs are
possessive and start only where a run can start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import written

KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Groups of digits with single blanks between them (no address of four parts, and nothing but marks of the sentence behind), or one run with digits or an ``@``.
_GROUP = r"(?!(?:[0-9]++\.){3}[0-9])[+(]?[0-9][0-9()./:-]*+(?![^\s,;!?\"'\]])"
_CANDIDATE = rf"(?<!\S)(?:(?:[A-Za-z_-]{{2,40}}[=:])?+{_GROUP}(?:\x20{_GROUP})++|(?>\S*[0-9@])\S*+)"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
_BLOCK = 128
_EDGES = ".,;:!?()[]\"'"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an integer array, in blocks so that no long array is copied per element."""

    def small(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(v, start, add, lambda s: s["out"])

    def whole(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))
        total = lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)
        placed = lambda bs: F.zip_with(bs, small(F.transform(bs, total)), lambda b, at: F.transform(small(b), lambda x: x + at))
        return F.when(F.size(v) > 0, F.flatten(_let(blocks, placed))).otherwise(F.array().cast("array<int>"))

    return _let(lengths, whole)


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) for the leftmost non-overlapping matches; before and after: text up to the neighbours."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)

    def place(x: Column) -> Column:
        steps = F.zip_with(x["found"], F.slice(x["rest"], F.lit(1), F.size(x["found"])), lambda m, r: F.length(r) + F.length(m))
        return F.transform(
            F.arrays_zip(x["found"].alias("found"), _prefix_sums(steps).alias("at"), F.slice(x["rest"], F.lit(1), F.size(x["found"])).alias("before"), F.slice(x["rest"], F.lit(2), F.size(x["found"])).alias("after")),
            lambda z: F.struct(
                (z["at"] + F.length(z["before"])).alias("start"), (z["at"] + F.length(z["before"]) + F.length(z["found"])).alias("end"),
                z["found"].alias("found"), z["before"].alias("before"), z["after"].alias("after"),
            ),
        )

    return _let(F.struct(found.alias("found"), rest.alias("rest")), place)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """12 to 19 digits whose Luhn sum ends in 0."""

    def add(d: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            v = F.ascii(F.substr(d, i, F.lit(1))) - 48
            return total + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return _let(F.reverse(_digits(s)), lambda d: F.when(F.length(d).between(12, 19), add(d)).otherwise(False))


_CHECKS: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "email": (_EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")),
    "card": (_CARD, lambda t: t.rlike("[0-9]"), _luhn),
    "phone": (_PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(9, 15)),
}


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in a non-null text, empty where it has none."""
    pattern, may, holds = _CHECKS[kind]
    rank = KINDS.index(kind)
    kept = F.transform(
        F.filter(_located(text, pattern), lambda m: holds(m["found"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(may(text), kept).otherwise(F.array().cast(_SPAN))


def _first(found: Column, kind: str) -> Column:
    """The first match of a kind within a run, null if there is none or its check fails; told from the run alone, so that many runs and spans of a text never meet each other."""
    pattern, may, holds = _CHECKS[kind]
    none = F.lit(None).cast("struct<start:int,rank:int,end:int,kind:string>")

    def place(said: Column) -> Column:
        start = F.instr(found, said) - 1
        return F.when(
            (said != "") & holds(said),
            F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(said)).cast("int").alias("end"), F.lit(kind).alias("kind")),
        ).otherwise(none)

    return F.when(may(found), _let(F.regexp_extract(found, pattern, 0), place)).otherwise(none)


def _candidates(text: Column) -> Column:
    """Identifier-like runs with their contexts and the kind of the fixed format within them, if any."""

    def cut(m: Column, x: Column) -> Column:
        """What of a run is the identifier: a base span within it, else what stands behind a label."""
        inside = x["meets"].isNotNull()
        skip = F.when(inside, x["meets"]["start"]).otherwise(F.length(x["label"]))
        size = F.when(inside, x["meets"]["end"] - x["meets"]["start"]).otherwise(F.length(m["found"]) - F.length(x["label"]))
        head = F.substr(m["found"], F.lit(1), skip)
        label = F.when(inside, F.regexp_extract(head, r"([A-Za-z_-]{2,40}[=:])$", 1)).otherwise(x["label"])
        return F.struct(
            skip.alias("skip"), F.substr(m["found"], skip + 1, size).alias("piece"), label.alias("label"), x["meets"]["kind"].alias("kind"),
            F.concat(F.right(m["before"], F.lit(60)), F.substr(head, F.lit(1), skip - F.length(label))).alias("left"),
            F.concat(F.substr(m["found"], skip + size + 1), F.left(m["after"], F.lit(60))).alias("right"),
        )

    def tell(m: Column, x: Column) -> Column:
        bare = F.ltrim(x["piece"], F.lit(_EDGES))
        start = m["start"] + x["skip"] + F.length(x["piece"]) - F.length(bare)
        core = F.rtrim(bare, F.lit(_EDGES))
        left = F.split(F.lower(F.rtrim(x["left"])), r"\s+", -1)
        right = F.get(F.split(F.lower(F.ltrim(x["right"])), r"\s+", -1), F.lit(0))
        one, two = F.coalesce(F.element_at(left, -1), F.lit("")), F.coalesce(F.when(F.size(left) > 1, F.element_at(left, -2)), F.lit(""))
        patterns = F.array(
            F.concat(F.lit("w1 "), one), F.concat(F.lit("w2 "), two, F.lit(" "), one),
            F.concat(F.lit("wr "), one, F.lit(" _ "), right), F.concat(F.lit("lb "), F.lower(x["label"])),
        )
        patterns = F.filter(patterns, lambda p: ~F.trim(p).isin("w1", "w2", "wr", "lb", "wr  _"))
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), x["kind"].alias("kind"), patterns.alias("patterns"))

    def describe(m: Column) -> Column:
        meets = F.get(F.array_sort(F.filter(F.array(*[_first(m["found"], k) for k in KINDS]), lambda b: b.isNotNull())), F.lit(0))
        met = F.struct(meets.alias("meets"), F.regexp_extract(m["found"], r"^([A-Za-z_-]{2,40}[=:])\S", 1).alias("label"))
        return _let(_let(met, lambda x: cut(m, x)), lambda x: tell(m, x))

    return F.when(text.rlike("[0-9@]"), F.transform(_located(text, _CANDIDATE), describe))


def _shaped(core: Column, kind: Column) -> Column:
    """Could the string be of that kind at all? An address has an ``@``, a number 5 digits and little else."""
    numeric = core.rlike(r"^[+(]?[0-9][0-9 ().:/-]*$") & (F.length(_digits(core)) >= 5)
    return F.when(kind == "email", F.contains(core, F.lit("@"))).otherwise(numeric)


def _open(found: Column) -> Column:
    """Is there a candidate without a kind that a pattern could give one?"""
    none = lambda c: c["kind"].isNull() & (_shaped(c["core"], F.lit("email")) | _shaped(c["core"], F.lit("ip")))
    return F.coalesce(F.exists(found, none), F.lit(False))


def learn_patterns(occurrences: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """``pattern, kind, confidence``: contexts that vouch for a kind.

    ``occurrences`` has ``core, kind (null if unknown), patterns``. A pattern needs
    ``support`` different seed strings of the kind and at least ``confidence`` of all its
    different strings trusted.
    """
    edges = written(occurrences.select("core", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "core").agg(F.min("kind").alias("kind")))
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("core").agg(F.min("kind").alias("kind")).withColumn("trust", F.lit(1.0))
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("strings"), F.count("kind").alias("seeds")).where(F.col("seeds") >= support)
    edges = written(edges.select("pattern", "core").join(wide, "pattern"))
    trusted = seeds
    best = None
    for _ in range(rounds):
        scored = (
            edges.join(trusted, "core").groupBy("pattern", "kind")
            .agg((F.sum("trust") / F.max("strings")).alias("confidence"), F.count_if(F.col("trust") == 1.0).alias("seeds"))
        )
        best = written(scored.where((F.col("confidence") >= confidence) & (F.col("seeds") >= support)).select("pattern", "kind", "confidence"))
        told = edges.join(best, "pattern").where(_shaped(F.col("core"), F.col("kind"))).groupBy("core", "kind")
        doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.99)))).alias("doubt")
        found = told.agg(doubt).select("core", "kind", (1.0 - F.exp("doubt")).alias("trust"))
        trusted = written(seeds.unionByName(found.join(seeds.select("core"), "core", "left_anti")))
    return best


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def located(docs: DataFrame, text: str = "text", carry: list[str] | None = None, **learning) -> DataFrame:
    """``doc`` (a struct of the row's columns, or of ``carry``), ``base_spans`` and ``spans`` (base and discovered), arrays of (start, rank, end, kind).

    ``start`` and ``end`` count code points, end exclusive. A null text counts as empty and
    has none; repeated rows keep theirs each; an empty table gives an empty result. Columns
    of any name are safe, since they stay within ``doc``.
    """
    keep = docs.columns if carry is None else carry
    body = F.col("body")
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("row"))
    base = rows.select("doc", "body", "row", *[base_spans(body, k).alias(k) for k in KINDS])
    base = base.select("doc", "body", "row", F.array_sort(F.concat(*KINDS)).alias("base_spans"))
    # Written once: what was found serves both the graph and the result.
    base = base.select("doc", "row", "base_spans", _candidates(body).alias("found"))
    base = written(base.withColumn("open", _open(F.col("found"))))
    seen = base.where(F.col("found").isNotNull()).select(F.col("row").alias("at"), F.explode("found").alias("f")).select("at", "f.*")
    vouch = learn_patterns(seen, **learning)
    unknown = seen.where(F.col("kind").isNull()).drop("kind").withColumn("pattern", F.explode("patterns"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    new = (
        unknown.join(vouch, "pattern").where(_shaped(F.col("core"), F.col("kind")))
        .groupBy("at", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .groupBy("at").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("new"))
    )
    # Only documents that may have discoveries meet them in a shuffle; the texts of the rest stay where they are.
    joined = base.where("open").join(new, F.col("row") == F.col("at"), "left")
    spans = F.array_sort(F.concat("base_spans", F.coalesce(F.col("new"), F.array().cast(_SPAN))))
    rest = base.where(~F.col("open")).select("doc", "base_spans", F.col("base_spans").alias("spans"))
    return rest.unionByName(joined.select("doc", "base_spans", spans.alias("spans")))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **learning) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text, per document."""
    found = located(docs, text, [doc_id], **learning)

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(F.col("doc")[doc_id].alias("doc_id"), *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", **learning) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one. A null text stays null."""
    found = located(docs, text, **learning)
    body = F.col("doc")[text]

    def merge(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        grown = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["end"] > x["start"]), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(grown))).otherwise(F.concat(s, F.array(x)))

    def rebuild(spans: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        parts = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, e: F.concat(F.substr(body, e + 1, s["start"] - e), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(parts, ""), F.substr(body, F.element_at(ends, -1) + 1))

    one = F.aggregate("spans", F.array().cast(_SPAN), merge)
    clean = F.when(F.size("spans") > 0, _let(one, rebuild)).otherwise(body)
    return found.select(*[(clean if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
