"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans. Spans of the base kinds
(email, ip, card, phone) that pass their format checks are selected as they
are. The other candidates get format and context features, are scored by
boosted trees, calibrated, and selected over a threshold per kind; of those
that overlap, the best one stays, and none that overlaps a base span.

Among the generators are two for what the base leaves behind: a base match
takes all digits it can reach, so two numbers side by side fail its check
together; ``card_part`` and ``phone_part`` propose the numbers by themselves.

The trees are fitted on the driver on ``EXAMPLES`` made spans, personal ones and
look-alikes, whose truth is known from how they were made, set in stretches of
the corpus's own text (``CONTEXTS`` rows, a documented bound, picked by a hash)
or in invented words; half of them calibrate and set the thresholds. Many have no
cue word beside them, or one that no feature knows. Features of the training spans come from the same expressions as those
of the corpus. Everything else is a map over rows: no shuffle, memory bounded
by the longest text.

Defined results: a null text counts as empty; repeated rows are judged each; an
empty table gives an empty result; other columns are ignored by ``detect`` and
kept by ``redact``.
"""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, calibrate, sigmoid
from .scratch import free
from .spans import add_spans, digits_of, luhn

LOCAL = "A-Za-z0-9._%+-"
BASE = ("email", "ip", "card", "phone")
#: kind, pattern, cheap condition that every match fulfils
BASE_PATTERNS = (
    ("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9][0-9\x20-]{14}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
EXTRA = ("masked_email", "local_phone", "id_number", "iban", "ipv6", "card_part", "phone_part")
EXTRA_PATTERNS = (
    ("masked_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{2,24}+){1,4}", r"[\[({](?:at|AT)[\])}]"),
    ("local_phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-]?[0-9]{4}"),
    ("id_number", r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{2}[\x20-]?[0-9]{4}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])", ":[0-9a-fA-F]{1,4}:"),
    ("card_part", r"(?<![0-9])(?<![0-9][.-])(?<![A-Z]{2}[0-9]{2}\x20)(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9]|[.-][0-9])", r"[0-9]{4}[\x20-]?[0-9]{4}"),
    ("phone_part", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]"),
)
#: words before or after a span that speak for personal data, or against it
FOR = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ssn|social|iban|account|bank|mail|e-mail|contact|reach|host|client|from|ip)\b"
AGAINST = r"(?i)\b(?:order|invoice|item|isbn|serial|part|version|ref|build|total|page|figure|no|sku|ticket|row)\b"
FEATURES = ("kind", "size", "digits", "letters", "seps", "distinct", "zero", "checks", "for_it", "against", "glued")
EXAMPLES = 4000
CONTEXTS = 300
_fitted: dict[tuple[int, int], tuple[Trees, float, float, dict[str, float]]] = {}


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _base_ok(kind: str):
    """The format check of a base kind, as a predicate of a span."""

    def short(part: Column) -> Column:
        return F.regexp_replace(part, "^0+", "")

    def byte(part: Column) -> Column:
        return (F.length(short(part)) < 3) | ((F.length(short(part)) == 3) & (short(part) <= "255"))

    return {
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), byte),
        "card": lambda s: (F.length(digits_of(s["value"])) <= 19) & luhn(digits_of(s["value"])),
        "phone": lambda s: F.length(digits_of(s["value"])).between(8, 15),
    }.get(kind, lambda s: F.lit(True))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``base``: the spans of the base kinds, by kind, then start."""
    parts = []
    for kind, pattern, hint in BASE_PATTERNS:
        df = add_spans(df, f"__{kind}", text, pattern, F.col(text).rlike(hint) if len(hint) > 1 else F.col(text).contains(hint))
        parts.append(_kind(F.filter(f"__{kind}", _base_ok(kind)), kind))
    return df.withColumn("base", F.concat(*parts)).drop(*[f"__{k}" for k in BASE])


def _mod97(value: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10."""
    v = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def candidates(df: DataFrame, text: str) -> DataFrame:
    """Add ``candidates``: spans of all extra kinds, overlapping, with their features."""
    parts = []
    for kind, pattern, hint in EXTRA_PATTERNS:
        df = add_spans(df, f"__{kind}", text, pattern, F.col(text).rlike(hint))
        parts.append(_kind(F.col(f"__{kind}"), kind))
    number = lambda c: c.cast("double")

    def features(s: Column) -> Column:
        v, start, end = s["value"], s["start"], s["end"]
        before = F.substring(F.col(text), F.greatest(F.lit(1), start - 23), F.least(F.lit(24), start))
        around = F.concat(before, F.lit(" "), F.substring(F.col(text), end + 1, F.lit(12)))
        digits = digits_of(v)
        kind = F.array_position(F.array(*[F.lit(k) for k in EXTRA]), s["kind"]) - 1
        checks = F.when(s["kind"] == "iban", _mod97(v)).when(s["kind"] == "id_number", ~digits.rlike("^(?:000|666|9)|^...00|0000$")).when(s["kind"] == "local_phone", digits.rlike("^[2-9]..[2-9]")).when(s["kind"] == "card_part", luhn(digits)).when(s["kind"] == "phone_part", F.length(digits).between(8, 15) & ~digits.rlike("^0")).otherwise(True)
        return F.struct(
            s["kind"].alias("name"), start.alias("start"), end.alias("end"), v.alias("value"),
            number(kind).alias("kind"), number(F.char_length(v)).alias("size"), number(F.length(digits)).alias("digits"),
            number(F.length(F.regexp_replace(v, "[^A-Za-z]", ""))).alias("letters"), number(F.length(F.regexp_replace(v, "[A-Za-z0-9]", ""))).alias("seps"),
            number(F.size(F.array_distinct(F.split(digits, "")))).alias("distinct"), number(F.startswith(digits, F.lit("0")).cast("int")).alias("zero"),
            number(checks.cast("int")).alias("checks"), number(around.rlike(FOR).cast("int")).alias("for_it"), number(around.rlike(AGAINST).cast("int")).alias("against"),
            number(before.rlike(r"[^\s(:=,;\"']$").cast("int")).alias("glued"),
        )

    return df.withColumn("__all", F.concat(*parts)).withColumn("candidates", F.transform("__all", features)).drop("__all", *[f"__{k}" for k in EXTRA])


def _luhn_digit(body: str) -> int:
    total = sum(d - 9 if d > 9 else d for k, c in enumerate(reversed(body)) for d in [int(c) * (1 if k % 2 else 2)])
    return -total % 10


def training_examples(n: int = EXAMPLES, seed: int = 17, contexts: list[str] | None = None) -> list[tuple[str, int, int]]:
    """``text, start, end``: stretches of text with a personal span, or with a look-alike (start -1)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdefgilmnoprstu") for _ in range(r.randint(3, 9)))

    def iban(valid: bool) -> str:
        body, country = "".join(r.choice("0123456789") for _ in range(18)), r.choice(["DE", "FR", "ES", "IT"])
        as_number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
        check = (98 - as_number % 97) if valid else (98 - as_number % 97 + r.randint(1, 90)) % 97
        plain = f"{country}{check:02d}{body}"
        return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if r.random() < 0.5 else plain

    def card(valid: bool) -> str:
        # some numbers repeat a few digits
        body = d(15) if r.random() < 0.7 else (lambda few: "".join(r.choice(few) for _ in range(15)))(d(r.randint(2, 4)))
        plain = body + str((_luhn_digit(body) + (0 if valid else r.randint(1, 9))) % 10)
        return r.choice(["", "", " ", "-"]).join(plain[i : i + 4] for i in range(0, 16, 4))

    def phone(valid: bool) -> str:
        form = r.choice(["+{c} ({a}) {b}-{e}", "+{c} {a} {b} {e}", "+{c}.{a}.{b}.{e}", "+{c}-{a}-{b}-{e}"])
        return form.format(c=r.choice(["1", "33", "44", "49", "351"]) if valid else r.choice(["0", "00", "000"]), a=d(3), b=d(3), e=d(4))

    def one() -> tuple[str, int, int]:
        truth, kind = r.random() < 0.5, r.randrange(len(EXTRA))
        lead = r.choice(["tel", "phone", "call", "contact", "mobile", "cell", "fax", "dial", "ring"]) if truth else r.choice(["order", "invoice", "serial", "ref", "part", "batch", "lot", word()])
        after = ""
        if kind == 0:
            value = f"{word()}.{word()} [at] {word()} [dot] com" if r.random() < 0.5 else f"{word()}(at){word()}.org"
            lead = r.choice(["mail", "write", word()]) if truth else word()
            value = value if truth else r.choice([f"{word()}[at]{d(2)} .{d(3)}", f"{word()}{{at}}{word()} .{word()}"])
        elif kind == 1:
            area = r.choice("23456789") + d(2) + r.choice("23456789") + d(2)
            value = f"({area[:3]}) {area[3:]}-{d(4)}" if r.random() < 0.5 else f"{area[:3]}-{area[3:]}-{d(4)}"
            value = value if truth else r.choice([d(10), f"{d(3)}.{d(3)}.{d(4)}", value.replace("(", "").replace(") ", "")])
        elif kind == 2:
            value = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            lead = r.choice(["ssn", "social", "insured"]) if truth else lead
            value = value if truth else r.choice([d(9), f"000-{d(2)}-{d(4)}", value])
        elif kind == 3:
            value, lead = iban(truth), r.choice(["iban", "account", "transfer", word()]) if truth else lead
        elif kind == 4:
            value = ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))
            lead = r.choice(["host", "client", "peer", "gateway"]) if truth else r.choice(["version", "build", word()])
            value = value if truth else ":".join(d(r.randint(1, 2)) for _ in range(8))
        elif kind == 5:
            value, after = card(truth), r.choice(["", " " + ".".join(d(2) for _ in range(4)), f" {d(3)}", f" {d(5)}"])
        else:
            value, after = phone(truth), r.choice(["", " " + ".".join(d(2) for _ in range(4)), f" {d(9)}"])
        # cue words stand beside less than half of the spans of kinds that a check tells apart
        cue = r.random() < (0.4 if kind in (3, 5, 6) else 0.9)
        around = r.choice(contexts) if contexts and r.random() < 0.7 else " ".join(word() for _ in range(r.randint(6, 16)))
        at = around.find(" ", r.randrange(max(1, len(around))))
        at = len(around) if at < 0 else at
        head = around[:at] + " " + (lead + r.choice([": ", " ", " "]) if cue else "")
        return head + value + after + around[at:], len(head) if truth else -1, len(head) + len(value)

    return [one() for _ in range(n)]


def context_sample(df: DataFrame, text_col: str, n: int = CONTEXTS) -> list[str]:
    """Stretches of 160 characters, without digits or ``@``, of at most ``n`` texts picked by a hash."""
    text = F.translate(F.col(text_col), "0123456789@+", "")
    long_enough = df.select(text.alias("t")).where(F.char_length("t") > 200)
    begins = F.pmod(F.xxhash64("t"), F.char_length("t") - 160).cast("int") + 1
    return [r["t"] for r in long_enough.select(F.substring("t", begins, F.lit(160)).alias("t"), F.xxhash64("t").alias("h")).orderBy("h", "t").limit(n).collect()]


def fit(spark: SparkSession, seed: int = 17, precision: float = 0.97, contexts: list[str] | None = None) -> tuple[Trees, float, float, dict[str, float]]:
    """Trees, calibration and the least probability per kind that keeps ``precision`` on held-out examples."""
    key = seed, zlib.crc32("\n".join(contexts or []).encode())
    if key in _fitted:
        return _fitted[key]
    rows = [{"k": k, "t": t, "s": s, "e": e} for k, (t, s, e) in enumerate(training_examples(seed=seed, contexts=contexts))]
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,t:string,s:int,e:int>>")
    table = spark.range(1).select(F.explode(made).alias("x")).select("x.*")
    found = candidates(table, "t").select("k", "s", "e", F.explode("candidates").alias("c")).select("k", ((F.col("c.start") == F.col("s")) & (F.col("c.end") == F.col("e"))).cast("int").alias("y"), F.col("c.name").alias("name"), *[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.start").alias("begin"), F.col("c.end").alias("end"))
    # what only overlaps the true span loses to it in the choice, so it is no example
    found = found.where((F.col("y") == 1) | (F.col("s") < 0) | (F.col("begin") >= F.col("e")) | (F.col("end") <= F.col("s"))).orderBy("k", "name", "begin").collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in found], float), np.array([r["y"] for r in found], float)
    held = np.array([r["k"] % 2 == 1 for r in found])
    model = Trees.fit(list(FEATURES), x[~held], y[~held], rounds=40, depth=3)
    margin = model.margin(x[held])
    a, b = calibrate(margin, y[held])
    p, names, least = sigmoid(a * margin + b), np.array([r["name"] for r in found])[held], {}
    for kind in EXTRA:
        mine, least[kind] = names == kind, 1.01
        for t in sorted(set(p[mine]), reverse=True):
            chosen = mine & (p >= t)
            # the lowest threshold that keeps the precision, whatever a few examples above it do
            if t >= 0.5 and y[held][chosen].mean() >= precision:
                least[kind] = float(t) - 1e-6
    _fitted[key] = model, a, b, least
    return _fitted[key]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per row: ``id, base, added``, arrays of ``kind, start, end, value`` (``added`` with ``score``)."""
    model, a, b, least = fit(df.sparkSession, seed, contexts=context_sample(df, text_col))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = candidates(base_spans(rows, "body"), "body").select("id", "base", "candidates")
    chance = f"1 / (1 + exp(-({a:.9f}D * ({model.sql('c')}) + {b:.9f}D)))"
    scored = F.expr(f"transform(candidates, c -> struct(c.name AS kind, c.start AS start, c.end AS end, c.value AS value, {chance} AS score))")
    limit = F.create_map(*[F.lit(v) for k in EXTRA for v in (k, least[k])])
    rows = rows.withColumn("scored", F.when(F.size("candidates") > 0, scored).otherwise(F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,value:string,score:double>>)")))
    over = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    rows = rows.withColumn("chosen", F.filter("scored", lambda s: (s["score"] >= F.element_at(limit, s["kind"])) & ~F.exists("base", lambda t: over(s, t))))
    better = lambda t, s: (t["score"] > s["score"]) | ((t["score"] == s["score"]) & (F.struct(t["start"], t["kind"]) < F.struct(s["start"], s["kind"])))
    added = F.filter("chosen", lambda s: ~F.exists("chosen", lambda t: over(s, t) & better(t, s)))
    return rows.select("id", "base", added.alias("added"))


def redact(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """``df`` with every selected span replaced by its kind in angle brackets."""
    key, spans = free(df, "__row"), free(df, "__spans")
    keyed = df.withColumn(key, F.struct(F.col(id_col), F.col(text_col)))
    found = detect(keyed.select(F.col(key), F.col(text_col)), key, text_col, seed).select(F.col("id").alias(key), F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias(spans)).where(F.size(spans) > 0).distinct()
    k, f = keyed.alias("k"), found.alias("f")
    joined = k.join(f, F.col(f"k.{key}").eqNullSafe(F.col(f"f.{key}")), "left").select("k.*", f"f.{spans}")

    def put(acc: Column, s: Column) -> Column:
        reached = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, reached - acc["at"]), F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.char_length(F.col(text_col))))
    text = F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, put, rest)).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*df.columns)
