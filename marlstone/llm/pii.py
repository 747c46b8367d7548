"""Personal data: proposed spans, scored by boosted trees, all in DataFrame functions.

Base rules find emails, IPs, cards and phone numbers. Generators with high
recall propose further spans that may overlap; boosted trees of depth two
score each by its format and context, and a calibrated threshold per kind
selects those that are added to the base spans.

The trees are fitted on counts of feature cells over all documents: a table
with a row for each cell that occurs. Features are coarse bins, so that the
table is bounded by the number of cells and no cell is left out. A cell's
target comes from a check that this kind's features don't show: check digits
of cards and bank accounts, an area code in brackets or an opening plus sign, an
assignment to a secret's name, a known end of a domain. Each kind has the
features that its check doesn't read.

A proposal is added if its score reaches its kind's threshold, and also if it
passes a check that chance hardly passes: a bank account's check digits, an
assignment to a secret's name, a domain's known end. So a kind too rare to be
learnt in this corpus is still found where it is certain.

Positions are counted in code points. A pattern's matches and the pieces
between them have the same order, so positions are running sums of lengths.
No pattern repeats a group, so that long runs don't grow the matcher's stack,
and each can only begin where a run begins, so that they take linear time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMPTY = "array<struct<kind:string,start:int,end:int,text:string,left:string,right:string>>"
CONTEXT = 24

#: In an email's domain a dot stands between two of these; elsewhere it counts as another sign of the local part.
LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: In a card's digits a space or hyphen stands between two digits.
LOOSE_SIGN = r"(?<![0-9])[ -]|[ -](?![0-9])"
CARD = r"(?<![0-9 -])[0-9][0-9 -]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Proposals beyond the base rules.
GENERATORS = (
    ("handle", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({]at[\])}] ?[A-Za-z0-9-]++ ?(?:[\[({]dot[\])}]|\.) ?| at [A-Za-z0-9-]++ dot )[A-Za-z]{2,}+"),
    ("number", r"(?<![A-Za-z0-9])\(?[0-9][0-9 ().-]{5,}[0-9](?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{16,}+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
#: Where a feature's bins after the first begin; other features have few values.
BINS = {"digits": (1, 4, 8, 10, 13, 16, 17, 20), "letters": (1, 3, 6, 11, 20), "signs": (1, 2, 3, 5), "longest": (1, 3, 4, 5, 8, 13, 16), "distinct": (5, 7, 9, 12, 16), "upper": (1, 2, 4)}
FEATURES = ("digits", "letters", "signs", "longest", "distinct", "upper", "cue", "left", "right", "paren")
#: What a kind's check reads, and its trees therefore don't.
CHECKED = {"number": ("left", "paren"), "secret": ("left", "right", "cue"), "iban": (), "handle": ()}
FEATURES_OF = {k: tuple(f for f in FEATURES if f not in CHECKED[k]) for k, _ in GENERATORS}
#: Kinds whose check is enough by itself.
SURE = ("secret", "iban", "handle")
#: Ends of domains, beside those of two letters.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "example", "test")


def running(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array of ints, in blocks, so that long arrays don't take quadratic time."""
    none = F.array().cast("array<int>")
    zero = F.lit(0)

    def sums(a: Column, base: Column) -> Column:
        return F.aggregate(a, F.struct(base.cast("int").alias("t"), none.alias("o")), lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"] + x)).alias("o")), lambda acc: acc["o"])

    n = F.size(lengths)
    parts = F.when(n > 0, F.transform(F.sequence(zero, F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))
    totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x))
    bases = F.concat(F.array(zero), sums(totals, zero))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(bases, 1, F.greatest(F.size(parts), zero)).alias("b")), lambda z: sums(z["p"], z["b"])))


def _found(df: DataFrame, name: str, kind: str, on: str, pattern: str, asked: Column, keep, context: bool) -> DataFrame:
    """Adds column ``name``: the pattern's matches in column ``on``, of the kind, that pass ``keep``."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(asked, F.regexp_extract_all(F.col(on), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.split(F.col(on), pattern, -1)).otherwise(none))
    n = F.size("__m")
    lengths = F.zip_with(F.slice("__p", 1, F.greatest(n, F.lit(0))), "__m", lambda a, b: (F.length(a) + F.length(b)).cast("int"))
    df = df.withColumn("__e", F.when(n > 0, running(lengths)).otherwise(F.array().cast("array<int>")))
    # Functions of elements see nothing but their element: what they named outside would be worked out anew for each.
    parts = [F.col("__m").alias("m"), F.col("__e").alias("e")]
    if context:
        parts += [F.slice("__p", 1, n).alias("l"), F.slice("__p", 2, n).alias("r")]

    def span(s: Column) -> Column:
        left = F.coalesce(F.right(s["l"], F.lit(CONTEXT)), F.lit("")) if context else F.lit("")
        right = F.coalesce(F.left(s["r"], F.lit(CONTEXT)), F.lit("")) if context else F.lit("")
        return F.struct(F.lit(kind).alias("kind"), (s["e"] - F.length(s["m"])).alias("start"), s["e"].alias("end"), s["m"].alias("text"), left.alias("left"), right.alias("right"))

    out = F.when(n > 0, F.transform(F.filter(F.arrays_zip(*parts), lambda s: keep(s["m"])), span)).otherwise(F.array())
    return df.withColumn(name, out.cast(EMPTY)).drop("__m", "__p", "__e")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value), F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _ip_ok(s: Column) -> Column:
    def part(x: Column) -> Column:
        x = F.regexp_replace(x, "^0+", "")
        return (F.length(x) < 3) | (F.length(x) == 3) & (x <= "255")

    return F.forall(F.split(s, r"\."), part)


def _card_ok(s: Column) -> Column:
    d = _digits(s)
    return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)


def _phone_ok(s: Column) -> Column:
    return F.length(_digits(s)).between(8, 15)


def base_spans(df: DataFrame, text: str = "__t") -> DataFrame:
    """Adds email, ip, card, phone: arrays of the base spans in column ``text`` (not null)."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    df = df.withColumn("__at", t.contains("@")).withColumn("__dig", digit)
    df = df.withColumn("__ed", F.when(F.col("__at"), F.regexp_replace(t, LOOSE_DOT, "%")))
    df = df.withColumn("__cd", F.when(F.col("__dig"), F.regexp_replace(t, LOOSE_SIGN, "_")))
    true = lambda s: F.lit(True)
    df = _found(df, "email", "email", "__ed", EMAIL, F.col("__at"), true, False)
    df = _found(df, "ip", "ip", text, IP, F.col("__dig"), _ip_ok, False)
    df = _found(df, "card", "card", "__cd", CARD, F.col("__dig"), _card_ok, False)
    df = _found(df, "phone", "phone", text, PHONE, F.col("__dig") & t.contains("+"), _phone_ok, False)
    return df.drop("__ed", "__cd", "__at", "__dig")


def proposals(df: DataFrame, text: str = "__t") -> DataFrame:
    """Adds ``proposed``: spans of all generators, which may overlap."""
    t = F.col(text)
    asked = {"handle": t.contains("[at]") | t.contains("(at)") | t.contains("{at}") | t.contains(" at ") & t.contains(" dot "), "number": t.rlike("[0-9]"), "secret": t.rlike("[0-9]"), "iban": t.rlike("[A-Z]{2}[0-9]{2}")}
    for kind, pattern in GENERATORS:
        keep = (lambda s: F.length(_digits(s)) >= 7) if kind == "number" else (lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")) if kind == "secret" else (lambda s: F.lit(True))
        df = _found(df, f"__g_{kind}", kind, text, pattern, asked[kind], keep, True)
    names = [f"__g_{k}" for k, _ in GENERATORS]
    return df.withColumn("proposed", F.concat(*names)).drop(*names)


CUES = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|iban|account|ssn|token|key|secret|password|passwd|pwd|auth|bearer)"


def feature(name: str, s: Column) -> Column:
    """A format or context feature of a span, as a small int: the bin where it has bins."""
    t = s["text"]
    n = {
        "digits": lambda: F.least(F.length(_digits(t)), F.lit(20)),
        "letters": lambda: F.least(F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.lit(20)),
        "signs": lambda: F.least(F.length(F.regexp_replace(t, "[A-Za-z0-9]", "")), F.lit(6)),
        "longest": lambda: F.least(F.coalesce(F.array_max(F.transform(F.split(t, "[^0-9]+"), lambda x: F.length(x))), F.lit(0)), F.lit(17)),
        "distinct": lambda: F.least(F.size(F.array_distinct(F.split(t, ""))), F.lit(16)),
        "upper": lambda: F.least(F.length(F.regexp_replace(t, "[^A-Z]", "")), F.lit(4)),
        "cue": lambda: s["left"].rlike(CUES).cast("int"),
        "left": lambda: F.when(s["left"].rlike(r"\+$"), 3).when(s["left"].rlike("[=:\"']\\s*$"), 2).when(s["left"].rlike(r"\s$") | (s["left"] == ""), 1).otherwise(0),
        "right": lambda: F.when(s["right"].rlike("^[\"']"), 2).when(s["right"].rlike(r"^\s") | (s["right"] == ""), 1).otherwise(0),
        "paren": lambda: t.contains("(").cast("int"),
    }
    value = n[name]().cast("int")
    if name not in BINS:
        return value
    # A table from values to bins, so that the value is worked out once.
    return F.get(F.array(*[F.lit(sum(v >= b for b in BINS[name])) for v in range(max(BINS[name]) + 1)]), F.least(value, F.lit(max(BINS[name]))))


def mod97(s: Column) -> Column:
    """Whether a bank account's check digits are right: its first four signs last, letters as 10 to 35, the rest by 97 is 1."""
    signs = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(signs, 5, 100), F.left(signs, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def silver(s: Column) -> Column:
    """Targets for fitting: what a check says that the kind's features don't show."""
    t, d = s["text"], _digits(s["text"])
    number = F.when(F.length(d).between(13, 19) & ~t.contains("."), luhn(d)).otherwise(F.length(d).between(8, 15) & (s["left"].rlike(r"\+$|\+[0-9]{1,3} $") | t.rlike(r"\([0-9]{2,4}\) ?[0-9]")))
    secret = s["left"].rlike(r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer)\w*\s*[=: ]\s*[\"']?$")
    end = F.lower(F.regexp_extract(t, "[A-Za-z]+$", 0))
    handle = (F.length(end) == 2) | end.isin(*DOMAIN_ENDS)
    return F.when(s["kind"] == "number", number).when(s["kind"] == "secret", secret).when(s["kind"] == "iban", mod97(t)).otherwise(handle).cast("int")


@dataclass
class Trees:
    """Per kind: depth-two trees ((f, cut, left split, right split) with leaves), a start and a threshold."""

    start: float
    trees: list
    cut: float


def fit_trees(cells: list[tuple[tuple[int, ...], int, int]], rounds: int = 12, rate: float = 0.4, min_weight: float = 4.0) -> tuple[float, list]:
    """Gradient boosting on (features, positives, rows) cells with second-order leaf values."""
    x = np.array([c[0] for c in cells], np.int64).reshape(len(cells), len(cells[0][0]) if cells else 0)
    y, n = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    p = min(max((y.sum() + 0.5) / (n.sum() + 1), 1e-4), 1 - 1e-4)
    start = math.log(p / (1 - p))
    score = np.full(len(cells), start)
    trees = []

    def grow(idx, depth):
        q = 1 / (1 + np.exp(-score[idx]))
        g, h = y[idx] - n[idx] * q, n[idx] * q * (1 - q)
        ga, ha, wa = g.sum(), h.sum(), n[idx].sum()
        gain, f, v = 1e-9, -1, 0
        for j in range(x.shape[1] if depth else 0):
            values = x[idx, j]
            gl, hl, wl = (np.cumsum(np.bincount(values, weights=w))[:-1] for w in (g, h, n[idx]))
            if not len(gl):
                continue
            found = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            found[(wl < min_weight) | (wa - wl < min_weight)] = 0
            k = int(found.argmax())
            if found[k] > gain + 1e-9:
                gain, f, v = float(found[k]), j, k
        if f < 0:
            step[idx] = rate * ga / (ha + 1)
            return float(rate * ga / (ha + 1))
        low = x[idx, f] <= v
        return (f, v, grow(idx[low], depth - 1), grow(idx[~low], depth - 1))

    for _ in range(rounds if 0 < y.sum() < n.sum() else 0):
        step = np.zeros(len(cells))
        trees.append(grow(np.arange(len(cells)), 2))
        score += step
    return start, trees


def tree_score(start: float, trees: list, x: tuple[int, ...]) -> float:
    for t in trees:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        start += t
    return start


def _tree_column(t, values: list[Column]) -> Column:
    if not isinstance(t, tuple):
        return F.lit(float(t))
    return F.when(values[t[0]] <= t[1], _tree_column(t[2], values)).otherwise(_tree_column(t[3], values))


def calibrated(cells, start: float, trees: list, precision: float, least_share: float = 1.0) -> float:
    """The least score from which on, in cells kept for it, the share of positives is high enough.

    Where positives are not all marked, as a secret that is assigned to no
    name, the share that is marked is taken from the best tenth of the marked
    ones, and is ``least_share`` at least.
    """
    order = sorted(((tree_score(start, trees, x), p, n) for x, p, n in cells), reverse=True)
    tops = []  # score, positives and rows from there up
    p_sum = n_sum = 0
    for k, (score, p, n) in enumerate(order):
        p_sum, n_sum = p_sum + p, n_sum + n
        if k + 1 == len(order) or order[k + 1][0] != score:
            tops.append((score, p_sum, n_sum))
    marked = next((p / n for _, p, n in tops if p and 10 * p >= p_sum), 1.0)
    share = min(1.0, max(marked, least_share))
    return min((s for s, p, n in tops if p >= precision * share * n), default=math.inf)


#: Kinds of whose positives the check marks only some, and the share that it marks at least.
MARKED = {"secret": 0.25}


def fit(docs: DataFrame, *, precision: float = 0.9) -> dict[str, Trees]:
    """Trees per kind, from the proposals of all documents as counts of cells.

    A fifth of the documents, by a hash of their text, is kept for the
    thresholds. All cells are used: their number follows from the bins, not
    from the documents.
    """
    df = proposals(docs.select(F.coalesce("text", F.lit("")).alias("__t")))
    # explode() would put a filter on the array below it, and so find all proposals twice.
    one = df.select((F.pmod(F.xxhash64("__t"), F.lit(5)) == 0).alias("kept"), F.explode_outer("proposed").alias("s")).where("s IS NOT NULL")
    cells = one.select("kept", F.col("s.kind").alias("kind"), *[feature(f, F.col("s")).alias(f) for f in FEATURES], silver(F.col("s")).alias("y"))
    rows = cells.groupBy("kept", "kind", *FEATURES).agg(F.sum("y").alias("p"), F.count("*").alias("n")).toArrow().sort_by([(c, "ascending") for c in ("kept", "kind", *FEATURES)])
    out = {}
    for kind in [k for k, _ in GENERATORS]:
        part = {}
        for kept in (True, False):
            of = rows.filter((pc.field("kind") == kind) & (pc.field("kept") == kept))
            part[kept] = list(zip(zip(*[of[f].to_pylist() for f in FEATURES_OF[kind]]), of["p"].to_pylist(), of["n"].to_pylist()))
        start, trees = fit_trees(part[False])
        out[kind] = Trees(start, trees, calibrated(part[True] or part[False], start, trees, precision, MARKED.get(kind, 1.0)))
    return out


def spans(docs: DataFrame, model: dict[str, Trees]) -> DataFrame:
    """Adds email, ip, card, phone (base spans) and added (further spans, apart from these and each other) to ``docs`` with __t."""
    df = proposals(base_spans(docs))
    df = df.withColumn("__base", F.concat(*KINDS))

    def value(s: Column) -> Column:
        chosen = s["kind"].isin(*SURE) & (silver(s) == 1)
        for kind, m in model.items():
            if m.cut == math.inf:
                continue
            values = [feature(f, s) for f in FEATURES_OF[kind]]
            score = F.lit(m.start)
            for t in m.trees:
                score = score + _tree_column(t, values)
            chosen = F.when((s["kind"] == kind) & (score >= m.cut - 1e-9), True).otherwise(chosen)
        return chosen

    # Base spans and proposals of a text in one order; a running end tells which proposals touch what began before.
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)
    is_base = lambda s: s["kind"].isin(*KINDS)
    df = df.withColumn("__in", F.filter("proposed", value))
    df = df.withColumn("__all", F.when(F.size("__in") > 0, F.array_sort(F.concat("__base", "__in"), order)).otherwise(F.array().cast(EMPTY)))
    zero = F.array(F.lit(0))
    # Ends of base spans before each element, and beginnings of base spans after it.
    df = df.withColumn("__hi", F.concat(zero, _running_max(F.transform("__all", lambda s: F.when(is_base(s), s["end"]).otherwise(0)))))
    df = df.withColumn("__lo", F.reverse(F.concat(F.array(F.lit(NEVER)), _running_max(F.transform(F.reverse("__all"), lambda s: F.when(is_base(s), -s["start"]).otherwise(NEVER))))))
    free = F.filter(
        F.arrays_zip(F.col("__all").alias("s"), F.slice("__hi", 1, F.size("__all")).alias("hi"), F.slice("__lo", 2, F.size("__all")).alias("lo")),
        lambda z: ~is_base(z["s"]) & (z["s"]["start"] >= z["hi"]) & (-z["lo"] >= z["s"]["end"]),
    )
    df = df.withColumn("__free", F.transform(free, lambda z: z["s"]))
    # Of added spans that overlap, the one that begins first, then the longest, stays.
    df = df.withColumn("__top", F.concat(zero, _running_max(F.transform("__free", lambda s: s["end"]))))
    kept = F.filter(F.arrays_zip(F.col("__free").alias("s"), F.slice("__top", 1, F.size("__free")).alias("t")), lambda z: z["s"]["start"] >= z["t"])
    df = df.withColumn("added", F.transform(kept, lambda z: z["s"]))
    return df.drop("proposed", "__base", "__in", "__all", "__hi", "__lo", "__free", "__top")


#: Below the negative of any position.
NEVER = -(2**31) + 1


def _named(col: Column) -> Column:
    return F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, model: dict[str, Trees] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans for every row of ``docs``.

    n_added counts the spans that the method adds, n_spans all spans.

    Null and empty texts have no spans. The added kinds stand after the base
    kinds, by name. Repeated rows each give a row; further columns are ignored.
    """
    if model is None:
        model = fit(docs)
    df = spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")), model)
    base = F.concat(*[_named(F.col(k)) for k in KINDS])
    more = F.when(F.size("added") > 1, F.array_sort("added", lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(a["start"] < b["start"], -1).otherwise(1))).otherwise(F.col("added"))
    return df.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _named(more)), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("added") + sum((F.size(k) for k in KINDS), F.lit(0))).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, model: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` with its spans replaced by their kinds in square brackets, as in [EMAIL].

    Spans that overlap become one, named for the first. Null texts stay null.
    """
    if model is None:
        model = fit(docs)
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}  # names that clash with none of these functions'
    named = [F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in own.items()]
    df = spans(docs.select(*named, F.coalesce("text", F.lit("")).alias("__t")), model)
    every = F.array_sort(F.concat(*KINDS, "added"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).otherwise(1))
    df = df.withColumn("__s", F.when(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") + F.size("added") > 0, every))
    # Where each span's text begins that no earlier span covers.
    df = df.withColumn("__from", F.when(F.col("__s").isNotNull(), F.concat(F.array(F.lit(0)), _running_max(F.transform("__s", lambda s: s["end"])))))

    def piece(z: Column) -> Column:
        s, begun = z["s"], z["f"]
        return F.when(s["start"] >= begun, F.concat(z["gap"], F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    # The text between spans, cut out of one pass over its pieces.
    n = F.size("__s")
    df = df.withColumn("__z", F.arrays_zip(F.col("__s").alias("s"), F.slice("__from", 1, F.greatest(n, F.lit(0))).alias("f")))
    df = df.withColumn("__pieces", F.transform(F.transform("__z", lambda z: F.struct(z["s"].alias("s"), z["f"].alias("f"), F.substring(F.col("__t"), z["f"] + 1, F.greatest(z["s"]["start"] - z["f"], F.lit(0))).alias("gap"))), piece))
    rest = F.substring(F.col("__t"), F.element_at("__from", -1) + 1, F.length("__t"))
    new = F.when(F.col(own["text"]).isNull(), None).when(F.col("__s").isNull(), F.col(own["text"])).otherwise(F.concat(F.array_join("__pieces", ""), rest))
    return df.select(*[new.alias(c) if c == "text" else F.col(k).alias(c) for c, k in own.items()])


def _running_max(a: Column, block: int = 256) -> Column:
    """Running largest values; in blocks, as running()."""
    none = F.array().cast("array<int>")

    def tops(p: Column, base: Column) -> Column:
        return F.aggregate(p, F.struct(base.cast("int").alias("t"), none.alias("o")), lambda acc, x: F.struct(F.greatest(acc["t"], x).alias("t"), F.concat(acc["o"], F.array(F.greatest(acc["t"], x))).alias("o")), lambda acc: acc["o"])

    n = F.size(a)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))
    bases = F.concat(F.array(F.lit(NEVER)), tops(F.transform(parts, F.array_max), F.lit(NEVER)))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(bases, 1, F.greatest(F.size(parts), F.lit(0))).alias("b")), lambda z: tops(z["p"], z["b"])))
