"""Secret scan: fixed patterns, and windows of high entropy over candidate strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import text_of

# The patterns that are always reported, in the order of their kinds.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 6
# A run shorter than the limit holds no longer run, so the limit may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Candidates of the entropy scan: whole runs of key characters, at least one
# window long, with a letter and a digit. Ordinary words never have both.
WINDOW = 20
CANDIDATE = (
    r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[0-9A-Za-z+/_-]{20,}"
)
# Character classes: kind, what a candidate of the class consists of, alphabet, bits per character.
CLASSES = (
    ("entropy_hex", "^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.0),
    ("entropy_key", "[^0-9A-Fa-f]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.7),
)
# Strings that look random but are samples or identifiers.
ALLOWED = (
    "(?i)(example|sample|dummy|placeholder|changeme)", "1234567890",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
# Matches of one text that are folded together.
GROUP = 256
_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), found from the pieces between them.

    A fold copies the list it adds to. So matches are folded in groups of
    GROUP, then the lengths of the groups, and each group is moved to its
    place: the work grows with the number of matches, not with its square.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    none = F.array().cast(_SPANS)

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def grouped(all_pairs: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / GROUP).cast("int")),
            lambda g: F.slice(all_pairs, g * GROUP + 1, F.lit(GROUP)))
        return F.transform(groups, lambda group: F.aggregate(group, F.struct(F.lit(0).alias("at"), none.alias("spans")), add))

    def placed(groups: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(groups, first, lambda state, group: F.struct(
            (state["at"] + group["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")),
            lambda state: state["starts"])
        return F.flatten(F.zip_with(groups, starts, lambda group, start: F.transform(group["spans"], lambda s: F.struct(
            (s["start"] + start).alias("start"), (s["end"] + start).alias("end"), s["value"].alias("value")))))

    return F.when(text.rlike(pattern), _let(_let(pairs, grouped), placed)).otherwise(none)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def hot_runs(value: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Runs (s, e) of overlapping windows of ``value`` whose Shannon entropy per character is at least ``bits``.

    One pass: the state holds the count of each character in the window and
    the sum of n * log2(n) over them. A step lets one character in and one
    out, which changes two counts and two terms of the sum. The entropy of a
    full window is log2(window) - sum / window.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(alphabet)))
    steps = F.zip_with(
        codes, F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes)),
        lambda a, b: F.struct(a.alias("comes"), b.alias("goes")))
    start = F.expr(
        f"named_struct('at', 0, 'sum', 0D, 'counts', array_repeat(0, {len(alphabet)}), "
        "'runs', cast(array() as array<struct<s:int,e:int>>))")

    def step(a: Column, p: Column) -> Column:
        comes, goes, counts = p["comes"], p["goes"], a["counts"]

        def term(n: Column) -> Column:
            return F.when(n > 0, n * F.log2(n)).otherwise(0.0)

        n_in = F.element_at(counts, comes)
        n_out = F.element_at(counts, F.greatest(goes, F.lit(1)))
        change = F.when(comes == goes, 0.0).otherwise(
            term(n_in + 1) - term(n_in) + F.when(goes > 0, term(n_out - 1) - term(n_out)).otherwise(0.0))
        total = a["sum"] + change
        at = a["at"] + 1
        last = F.element_at(a["runs"], -1)
        # A sum that went up and down by many terms may be off by its last digits.
        hot = (at >= window) & (F.round(F.log2(F.lit(float(window))) - total / window, 9) >= bits)
        joins = (F.size(a["runs"]) > 0) & (F.coalesce(last["e"], F.lit(-1)) >= at - window)
        runs = F.when(~hot, a["runs"]).when(
            joins, F.concat(F.slice(a["runs"], F.lit(1), F.size(a["runs"]) - 1),
                            F.array(F.struct(last["s"].alias("s"), at.alias("e"))))
        ).otherwise(F.concat(a["runs"], F.array(F.struct((at - window).alias("s"), at.alias("e")))))
        moved = F.transform(counts, lambda c, i: c + (i + 1 == comes).cast("int") - (i + 1 == goes).cast("int"))
        return F.struct(at.alias("at"), total.alias("sum"), moved.alias("counts"), runs.alias("runs"))

    return F.aggregate(steps, start, step, lambda a: a["runs"])


def _class_spans(found: Column, order: int, kind: str, consists: str, alphabet: str, bits: float) -> Column:
    """The spans of hot runs inside the candidates of one character class."""
    def own(v: Column) -> Column:
        keep = v["value"].rlike(consists)
        for pattern in ALLOWED:
            keep = keep & ~v["value"].rlike(pattern)
        return keep

    def spans(v: Column) -> Column:
        return F.transform(hot_runs(v["value"], alphabet, bits), lambda r: F.struct(
            (v["start"] + r["s"]).alias("start"), F.lit(order).alias("order"), (v["start"] + r["e"]).alias("end"),
            F.lit(kind).alias("kind")))

    return F.flatten(F.transform(F.filter(found, own), spans))


def _typed(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """All spans of each document: ``doc_id, base, added`` as arrays of (start, order, end, kind), each sorted.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Places
    are code points, ends are exclusive. ``base`` has the fixed patterns: per
    kind the leftmost non-overlapping matches, an assignment only with a value
    of 6 or more characters. ``added`` has the runs of hot windows that no
    base span covers and that are not on the allow list. A null text counts as
    empty and has no spans; repeated rows give repeated results.
    """
    text = F.col("_text")
    rows = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id",
        matches(text, ASSIGN).alias("_assign"),
        F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(
            F.array().cast("array<string>")).alias("_values"),
        matches(text, ACCESS).alias("_access"), matches(text, HEX).alias("_hex"),
        matches(text, CANDIDATE).alias("_candidates"))
    long_enough = F.transform(F.filter(
        F.arrays_zip(F.col("_assign"), F.col("_values")), lambda z: F.length(z["_values"]) >= ASSIGN_VALUE),
        lambda z: z["_assign"])
    base = F.array_sort(F.concat(
        _typed(long_enough, 0, "assign"), _typed(F.col("_access"), 1, "access"), _typed(F.col("_hex"), 2, "hex")))
    added = F.when(F.size("_candidates") > 0, F.array_sort(F.concat(*[
        _class_spans(F.col("_candidates"), order, *given) for order, given in enumerate(CLASSES, 3)])))
    rows = rows.select("doc_id", base.alias("base"), added.alias("added"))
    covered = lambda s: F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    none = F.filter("base", lambda s: F.lit(False))
    return rows.select("doc_id", "base", F.coalesce(F.filter("added", lambda s: ~covered(s)), none).alias("added"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``secret_spans``: ``doc_id, n_assign, n_access, n_hex, n_added, base_sha256, spans``."""
    def count(order: int) -> Column:
        return F.size(F.filter("base", lambda s: s["order"] == order)).cast("long")

    return secret_spans(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_added"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
