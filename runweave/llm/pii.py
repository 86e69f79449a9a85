"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score.

DataFrame operations only. A pattern's matches are marked with a control character in one
replace, and the marked text split there, so positions are running lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

MARK, STAND_IN = "\x01", "\x02"

# fixed values: the four base patterns, in the order their spans are listed. A look-behind
# or the end of the last match keeps a run of characters from being tried at each of its
# positions; nothing could match later in a run that fails at its start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what the method adds: pattern, score when proposed, words that raise it
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.2, r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b"),
    "local_phone": (r"(?<![0-9+.()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", 0.3, r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|contact)\b"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
}
NEAR, CONTEXT, CHECKED, ENOUGH = 40, 0.4, 0.6, 0.6
# what every match of a kind contains
NEEDS = {"email": "@", "phone": "+", "ip": "."}
HINTS = {"card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": "-[0-9]{2}-"}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    return F.rlike(x, F.lit(rf"^(?:{part}|0+)(?:\.(?:{part}|0+)){{3}}$"))


def mod97(x: Column) -> Column:
    """Remainder of an IBAN's number: country and check digits last, letters as 10 to 35."""
    plain = F.regexp_replace(x, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(F.rlike(c, F.lit("[0-9]")), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return _octets(x)
    if kind == "card":
        return (n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,match:string>>"


def _spans(marked: str) -> Column:
    """Spans of a marked text: every second piece between marks is a match."""
    walk = f"""aggregate(split({marked}, '{MARK}'),
        named_struct('odd', false, 'at', 0, 'out', cast(array() as {_SPAN})),
        (a, x) -> named_struct('odd', not a.odd, 'at', a.at + length(x),
            'out', if(a.odd, concat(a.out, array(named_struct('start', a.at, 'end', a.at + length(x), 'match', x))), a.out)),
        a -> a.out)"""
    return F.expr(f"if(instr({marked}, '{MARK}') > 0, {walk}, cast(array() as {_SPAN}))")


def _scored(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))


def _confirmed(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["match"]))


def _added(kind: str, text: str, spans: Column, base: str) -> Column:
    _, first, words = ADDED[kind]

    def score(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - NEAR + 1), F.least(F.lit(NEAR), s["start"]))
        after = F.substring(text, s["end"] + 1, F.lit(NEAR))
        said = F.when(F.rlike(before, F.lit(words)) | F.rlike(after, F.lit(words)), CONTEXT).otherwise(0.0)
        check = F.when(mod97(s["match"]) == 1, CHECKED).otherwise(-CONTEXT) if kind == "iban" else F.lit(0.0)
        return F.lit(first) + said + check

    free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    each = F.transform(free, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")))
    return F.filter(each, lambda s: s["score"] >= ENOUGH)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and base and spans: arrays of (kind, start, end, score).

    Starts and ends are in code points, ends exclusive. base holds the confirmed matches of
    BASE by kind, then start; spans those and, after them, ADDED ones that overlap no
    base span and whose score (pattern, checksum, words up to NEAR code points before or
    after) reaches ENOUGH. A null text counts as empty and has none; repeated rows are each
    searched; an empty table gives no rows. Columns of docs named base or spans are
    replaced, all others are kept whatever their names.
    """
    kinds = [*BASE.items(), *((k, v[0]) for k, v in ADDED.items())]
    t, b, *names = unused(docs, "t", "b", *(f"m_{k}" for k, _ in kinds), *(f"s_{k}" for k in BASE))
    marked, checked = dict(zip([k for k, _ in kinds], names)), dict(zip(BASE, names[len(kinds) :]))
    d = docs.withColumn(t, F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN))
    marks = {}
    for kind, pattern in kinds:
        m = F.regexp_replace(t, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
        # most texts lack what a kind cannot do without; they are not searched for it
        may = F.instr(t, NEEDS[kind]) > 0 if kind in NEEDS else F.rlike(t, F.lit(HINTS[kind]))
        marks[marked[kind]] = F.when(may, m).otherwise("")
    d = d.withColumns(marks)
    d = d.withColumns({checked[k]: _confirmed(k, _spans(marked[k])) for k in BASE})
    d = d.withColumn(b, F.concat(*[_scored(k, F.col(checked[k])) for k in BASE]))
    spans = F.concat(F.col(b), *[_added(k, t, _spans(marked[k]), b) for k in ADDED])
    return d.select(*[c for c in docs.columns if c not in ("base", "spans")], F.col(b).alias("base"), spans.alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """find_pii's result with each span in the text replaced by its kind in angle brackets; spans that overlap become one."""
    walk = f"""aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> if(s.start >= a.at,
            named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), concat('<', upper(s.kind), '>')))),
            named_struct('at', greatest(a.at, s.end), 'out', a.out)),
        a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"""
    return found.withColumn(text, F.expr(f"if(size(spans) > 0, {walk}, {text})"))
