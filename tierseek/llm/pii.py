"""Personal data: pattern spans, and further spans that boosted trees accept among over-generated candidates.

Everything on the executors is DataFrame functions. The trees are fitted on the driver, on a bounded set of
labelled lines (``LABELLED_LINES``) whose features the same DataFrame functions compute, and become CASE expressions.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierseek.llm.common import let

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a failed start is not tried again inside the same run of characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: High-recall generators; what they propose may overlap.
CANDIDATES = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}){1,6}"),
    ("email", r"[A-Za-z0-9._%+-]{1,64}\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{1,63}){1,6}"),
    ("ip", r"[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])"),
)
TRIGGER = r"[0-9@]|[\[({]\x20?(?:at|AT)\x20?[\])}]|\x20(?:dot|DOT)\x20"
#: Words that speak for a kind when they stand shortly before a span.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|schreiben|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|addr(?:ess)?|ping|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pay(?:ment)?)\b",
    "phone": r"(?i)\b(?:phone|tel(?:ephone)?|call|fax|mobile|cell|sms|dial|telefon|tél|teléfono)\b",
}
COUNTER_CUES = r"(?i)\b(?:order|invoice|isbn|version|serial|sku|part|ticket|build|ref|id|no)\b[^\n]{0,6}$"
FEATURES = ("kind", "digits", "seps", "luhn", "cue", "counter", "glued", "brackets", "one_digit")
LABELLED_LINES = 1600
PLACES = 256


def _starts(gaps: Column, found: Column) -> Column:
    """Where each match starts, in code points. Two levels of sums, so that n matches cost about n * PLACES."""
    lens = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def sums(l: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(l) / PLACES).cast("int")), lambda b: total(F.slice(l, b * PLACES + 1, PLACES))
        )
        before = lambda bs: F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b)))
        return let(
            let(blocks, before),
            lambda up: F.transform(
                l,
                lambda _, i: F.get(up, F.floor(i / PLACES).cast("int"))
                + total(F.slice(l, F.floor(i / PLACES).cast("int") * PLACES + 1, i % PLACES))
                + F.length(F.get(gaps, i)),
            ),
        )

    return let(lens, sums)


def _spans(text: Column, kind: str, pattern: str, context: bool = False) -> Column:
    """array<struct<start, kind, end, text[, left, right]>> of the leftmost non-overlapping matches."""

    def build(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]

        def each(s: Column) -> Column:
            return F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(s, i).alias("start"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (F.get(s, i) + F.length(m)).alias("end"),
                    m.alias("text"),
                    *([F.right(F.get(gaps, i), F.lit(40)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("right")] if context else []),
                ),
            )

        return let(_starts(gaps, found), each)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), build)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of 12 to 19 digits; false for other lengths."""
    return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda x: _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, sorted by start and then kind."""
    valid = lambda k: lambda s: VALID[k](s["text"])
    return F.sort_array(F.concat(*[F.filter(_spans(text, k, p), valid(k)) for k, p in BASE.items()]))


def _features(s: Column) -> Column:
    """A candidate's features, all double, in the order of FEATURES."""
    x, kind = s["text"], s["kind"]
    digits = _digits(x)
    cue = reduce(lambda a, k: F.when(kind == KINDS.index(k), s["left"].rlike(CUES[k])).otherwise(a), KINDS, F.lit(False))
    glued = s["left"].rlike(r"[\p{L}0-9_=/#\"]$") | s["right"].rlike(r"^[\p{L}0-9_/\"]")
    values = (
        kind,
        F.length(digits),
        F.length(F.regexp_replace(x, r"[^\x20.-]+", "")),
        _luhn(digits),
        cue,
        s["left"].rlike(COUNTER_CUES),
        glued,
        F.length(F.regexp_replace(x, r"[^\[\](){}]+", "")),
        x.rlike(r"([0-9])[\x20.-]?(?:\1[\x20.-]?){8,}"),
    )
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, text, left, right, x>> with features x, of all generators."""
    found = F.concat(*[_spans(text, k, p, context=True) for k, p in CANDIDATES])
    return F.transform(found, lambda s: s.withField("x", _features(s)))


def labelled_lines(n: int = LABELLED_LINES, seed: int = 11) -> list[tuple[str, int]]:
    """n made-up lines that each hold one candidate, and whether it is personal data. No document is read."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("aeinorstlmu") for _ in range(r.randint(2, 8)))

    def luhn(k: int, good: bool) -> str:
        body = d(k - 1)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if good else r.randint(1, 9))) % 10)

    cue = {"email": "contact e-mail reach mail", "ip": "host server ip login", "card": "card visa payment credit", "phone": "phone call tel mobile"}
    out = []
    for _ in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        tail = ""
        if kind == "email":
            a, b = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot ")])
            x = f"{w()}{a}{w()}{b}{r.choice(['com', 'org', 'net'])}"
            lead = r.choice(cue[kind].split()) if good else w()
            if not good:
                x = f"{w()} at {w()} dot {w()}"
        elif kind == "ip":
            group = lambda: f"{r.randrange(1, 65536):x}"
            x = r.choice(["[.]".join(str(r.randint(1, 255)) for _ in range(4)), ":".join(group() for _ in range(8)), ":".join(f"{r.randint(0, 9)}{r.randrange(4096):x}" for _ in range(r.randint(1, 4))) + "::" + f"{r.randint(0, 9)}{r.randrange(4096):x}"])
            if not good and r.random() < 0.5:  # names of a scope, in letters alone
                x = "::".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 4))) for _ in range(2))
            lead = r.choice([w(), *cue[kind].split()]) if good else r.choice(["version", "build", "serial", "part"])
        elif kind == "card":
            x = luhn(16 if r.random() < 0.8 else 15, good)
            if r.random() < 0.4 and len(x) == 16:
                x = r.choice(" -.").join(x[i : i + 4] for i in range(0, 16, 4))
            lead = r.choice([w(), d(r.randint(1, 6)), *cue[kind].split()])
            if not good and r.random() < 0.3:
                x, lead = luhn(16, True), f'{w()} = "'
                tail = w()
        else:
            sep = r.choice(" .-")
            x = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{r.randint(1, 9)}{sep}{d(3)}{sep}{d(4)}"])
            # in this format a number is personal without a cue, too, unless a word speaks against it
            lead = r.choice([w(), *cue[kind].split()]) if good else r.choice(["order", "invoice", "serial", "ticket"])
        out.append((f"{w()} {lead}{'' if lead.endswith(chr(34)) else ' '}{x}{tail} {w()}", int(good)))
    return out


class Trees:
    """Gradient boosting for the logistic loss: depth-two trees on few features, then calibrated by Platt's method."""

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate, self.trees = rounds, rate, []

    def _leafwise(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(g.sum() / (h.sum() + 1.0))
        best = (1e-6, None)
        if depth:
            top = g.sum() ** 2 / (h.sum() + 1.0)
            for f in range(x.shape[1]):
                for t in np.unique(x[:, f])[:-1]:
                    m = x[:, f] <= t
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (m, ~m)) - top
                    if gain > best[0]:
                        best = (gain, (f, float(t), m))
        if best[1] is None:
            return leaf
        f, t, m = best[1]
        return (f, t, self._leafwise(x[m], g[m], h[m], depth - 1), self._leafwise(x[~m], g[~m], h[~m], depth - 1))

    def _value(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.array([sum(self.rate * self._value(t, row) for t in self.trees) for row in x])

    def fit(self, x: np.ndarray, y: np.ndarray, precision: float = 0.99) -> Trees:
        """Trees on the even rows; calibration and threshold on the odd ones."""
        a, b, s = x[::2], x[1::2], np.zeros(len(x[::2]))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-s))
            tree = self._leafwise(a, y[::2] - p, p * (1 - p), 2)
            self.trees.append(tree)
            s += np.array([self.rate * self._value(tree, row) for row in a])
        z, t = self.raw(b), y[1::2]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            g, v = np.array([((t - p) * z).sum(), (t - p).sum()]), p * (1 - p) + 1e-9
            step = np.linalg.solve(np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-3 * np.eye(2), g)
            self.slope, self.shift = self.slope + step[0], self.shift + step[1]
        p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
        ok = [c for c in sorted({*p}) if c >= 0.5 and t[p >= c].mean() >= precision]
        self.threshold = float(ok[0]) if ok else 2.0
        self.held_out = {"precision": float(t[p >= self.threshold].mean()) if ok else 1.0, "recall": float((p >= self.threshold)[t == 1].mean())}
        return self

    def column(self, x: Column) -> Column:
        """The calibrated probability as an expression over the array of features."""

        def branch(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(F.get(x, F.lit(tree[0])) <= tree[1], branch(tree[2])).otherwise(branch(tree[3]))

        raw = reduce(lambda a, b: a + b, [branch(t) * self.rate for t in self.trees])
        return 1 / (1 + F.exp(-(raw * float(self.slope) + float(self.shift))))


_fitted: dict[str, Trees] = {}


def model(spark: SparkSession) -> Trees:
    """Fitted once a process, on LABELLED_LINES rows at most."""
    if "model" not in _fitted:
        lines = labelled_lines()
        rows = F.explode(F.split(F.lit("\n".join(f"{y}{t}" for t, y in lines)), "\n")).alias("r")
        df = spark.range(1).select(rows).select(F.substring("r", 2, 1000).alias("text"), F.left("r", F.lit(1)).cast("int").alias("y"))
        got = df.select("y", F.transform(candidates(F.col("text")), lambda c: c["x"]).alias("x")).collect()
        pairs = [(v, r["y"]) for r in got for v in r["x"]]
        _fitted["model"] = Trees().fit(np.array([v for v, _ in pairs]), np.array([y for _, y in pairs], float))
    return _fitted["model"]


def find_pii(df: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """df with ``base`` and ``spans``: arrays of struct<start, kind, end, text>, by start and then kind.

    Offsets are code points, the end exclusive; kind indexes KINDS. ``spans`` holds the base spans and each candidate
    that the trees accept, that overlaps no base span, and that no overlapping accepted candidate outranks by
    (probability, length, earliest start). Null and empty texts have no spans. Rows are independent, so
    repeated rows get equal results; extra columns pass through, but columns named base or spans are replaced.
    """
    trees = trees or model(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<start:int,kind:int,end:int,text:string>>"
    none = F.array().cast(kind)
    base = F.when(t.rlike(TRIGGER), base_spans(t).cast(kind)).otherwise(none)

    def more(b: Column) -> Column:
        scored = F.transform(
            candidates(t),
            lambda c: F.struct(trees.column(c["x"]).alias("p"), (c["end"] - c["start"]).alias("n"), (-c["start"]).alias("s"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")),
        )
        good = F.filter(
            scored, lambda c: (c["p"] >= trees.threshold) & ~F.exists(b, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        )
        best = lambda g: F.filter(
            g, lambda c: ~F.exists(g, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (F.struct(o["p"], o["n"], o["s"], o["kind"]) > F.struct(c["p"], c["n"], c["s"], c["kind"])))
        )
        one = F.array_distinct(F.transform(let(good, best), lambda c: F.struct(c["start"], c["kind"], c["end"], c["text"]).cast(kind[6:-1])))
        return F.struct(b.alias("base"), F.when(t.rlike(TRIGGER), F.sort_array(F.concat(b, one))).otherwise(b).alias("spans"))

    out = df.withColumn("__p", let(base, more))
    return out.withColumns({"base": F.col("__p.base"), "spans": F.col("__p.spans")}).drop("__p")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """df with each span of its text replaced by its kind in brackets. Overlapping spans become one, under the first's kind.

    A null text stays null. No other column changes.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # the row travels whole in one column, so that no name of its columns can clash
    found = find_pii(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(text).alias("text")), "text", trees)

    def new(s: Column) -> Column:
        # a span that starts inside an earlier one adds no mark, and the text goes on at the furthest end so far
        reach = lambda i: F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda x: x["end"]))
        parts = F.transform(
            s,
            lambda x, i: let(
                F.coalesce(F.when(i > 0, reach(i)), F.lit(0)),
                lambda at: F.when(x["start"] < at, F.lit("")).otherwise(
                    F.concat(F.substring(F.col("text"), at + 1, x["start"] - at), F.get(names, x["kind"]))
                ),
            ),
        )
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(F.col(text), last + 1, F.length(F.col(text))))

    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(F.col("spans"), new))
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def pii_digest(df: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, a hash of them, and all spans."""
    found = find_pii(df.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
