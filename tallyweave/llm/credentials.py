"""Secret scan with multipart credential linking, in Spark's own functions.

Three kinds of span are reported wherever they stand: assignments of passwords
and the like, access key ids, and long hexadecimal runs. The method adds weak
candidates: opaque tokens that say nothing by themselves. They are joined over
intervals with what would make them a credential, an access identifier or an
endpoint in the same scope; only those with such a partner are reported. Scopes
end at blank lines. The user info and the query values of an
endpoint are candidates too, and the endpoint around them is their partner; the
rest of an endpoint, its path among it, and the value of an identifier are none.

The parts of a credential stand in one text, so the join runs inside the row:
nothing is shuffled, and no key can be hot. Candidates and what they are held
against lie in one array ordered by place, in which a running maximum tells each
candidate the nearest partner or scope end, or how far the spans before it
reach. So a text of n spans takes n log n steps, not n times n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import fresh_names

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
# Names begin a word, also behind a dash, an underscore or as a hump (dbUser); a secret access key is no identifier.
IDENTIFIER = r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?<!(?i:secret|shared)[_-]?)((?i:client_?id|user_?name|user|login|account(?:_?id)?|access_?key(?:_?id)?|tenant(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
SECRET = r"""(?i:secret[_-]?access[_-]?key|(?:secret|private|account|shared(?:[_-]?access)?|signing|encryption|auth)[_-]?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]{20,}+)"""
_SCHEME, _USER = r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3)://", "[A-Za-z0-9._~!$&*+,;=%-]"
USER = rf"{_SCHEME}({_USER}{{20,}}+)(?=(?::{_USER}*+)?@)"
PASSWORD = rf"{_SCHEME}{_USER}*+:({_USER}{{20,}}+)(?=@)"
QUERY = r"[?&;#][A-Za-z0-9_.~%-]*+=([A-Za-z0-9+/_=.~%-]{19,}[A-Za-z0-9+/_=~%-])"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
SCOPE_END = r"\n[\x20\t]*\n"

KINDS = ("assign", "access", "hex", "weak")
SPANS = "array<struct<start: int, kind: int, end: int>>"


_BOUND = 9
_LEAST = -(2**62)


@dataclass(frozen=True)
class Linking:
    """``reach``: most characters between a weak candidate and its partner; None: the whole scope. ``variety``:
    least number of different characters of an opaque token, which also needs a digit and a letter."""

    reach: int | None = None
    variety: int = 10


def _none() -> Column:
    return F.array().cast(SPANS)


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, both) -> Column:
    """``both`` folded over each prefix of an array of longs, by doubling: n log n steps."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), rounds), lambda j: F.pow(F.lit(2.0), j).cast("int"))
    over = lambda acc, step: F.transform(acc, lambda x, i: F.coalesce(both(x, F.get(acc, i - step)), x))
    return F.aggregate(steps, values, over)


def spans(text: Column, pattern: str, kind: int, ok=None, group: int = 0, tail: bool = False) -> Column:
    """Leftmost non-overlapping matches as ``SPANS``, in code points; ``ok`` takes the match's ``group``.

    ``tail``: the group ends the match, and the span is the group's alone.
    The pieces between the matches tell where they are, so no position function is needed.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)

    def placed(sizes: Column) -> Column:
        ends = running(F.zip_with(F.slice(pieces, F.lit(1), F.size(sizes)), sizes, lambda p, n: F.length(p).cast("long") + n), lambda a, b: a + b)
        return F.zip_with(F.zip_with(ends, sizes, lambda e, n: F.struct(e.cast("int").alias("end"), n.cast("int").alias("size"))), value, one)

    def one(a: Column, v: Column) -> Column:
        first = a["end"] - (F.length(v) if tail else a["size"])
        good = ok(v) if ok else F.lit(True)
        return F.struct(first.alias("start"), F.lit(kind).alias("kind"), a["end"].alias("end"), good.alias("ok"))

    every = _named(F.transform(found, lambda m: F.length(m).cast("long")), placed)
    # Most texts have no match: one search decides, the rest is not evaluated.
    return F.when(text.rlike(pattern), plain(F.filter(every, lambda s: s["ok"]))).otherwise(_none())


def plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def marked(found: Column, ok: bool = False) -> Column:
    """Spans with a mark ``ok`` that the tests below may set."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(ok).alias("ok")))


def _against(cands: Column, others: Column, key, at, value, hit, ties: bool) -> Column:
    """Marks candidates for which ``hit(candidate, m)`` holds, where m is the largest ``value`` of the
    others with ``at`` below the candidate's ``key`` (``ties``: or equal to it)."""
    of_other = F.transform(others, lambda o: F.struct(
        at(o).cast("long").alias("pos"), F.lit(0 if ties else 1).alias("turn"), value(o).cast("long").alias("v"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("end"), F.lit(False).alias("ok"),
    ))
    of_cand = F.transform(cands, lambda c: F.struct(
        key(c).cast("long").alias("pos"), F.lit(1 if ties else 0).alias("turn"), F.lit(_LEAST).cast("long").alias("v"),
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["ok"].alias("ok"),
    ))

    def tested(events: Column) -> Column:
        best = running(F.transform(events, lambda e: e["v"]), F.greatest)
        both = F.zip_with(events, best, lambda e, m: F.struct(
            e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end"), (e["ok"] | hit(e, m)).alias("ok")
        ))
        return F.filter(both, lambda c: c["start"].isNotNull())

    some = (F.size(cands) > 0) & (F.size(others) > 0)
    return F.when(some, _named(F.array_sort(F.concat(of_other, of_cand)), tested)).otherwise(cands)


def meeting(cands: Column, others: Column) -> Column:
    """Marks candidates that share a character with one of the others."""
    return _against(cands, others, lambda c: c["end"], lambda o: o["start"], lambda o: o["end"], lambda c, m: m > c["start"], False)


def inside(cands: Column, others: Column) -> Column:
    """Marks candidates that lie within one of the others, behind its first character."""
    return _against(cands, others, lambda c: c["start"], lambda o: o["start"], lambda o: o["end"], lambda c, m: m >= c["end"], False)


def joined(cands: Column, partners: Column, bounds: Column, reach: int | None) -> Column:
    """Marks candidates with a partner apart from them, in reach, with no scope end between.

    Seen from either side, the nearest partner or scope end decides: no partner
    behind a scope end counts, and one farther off than the nearest is no nearer.
    Doubled places tell partners (odd) from scope ends (even).
    """
    others = F.concat(partners, bounds)
    for key, at in ((lambda c: c["start"], lambda o: o["end"]), (lambda c: -c["end"], lambda o: -o["start"])):
        def value(o: Column, at=at) -> Column:
            return at(o).cast("long") * 2 + (o["kind"] != _BOUND).cast("long")

        def hit(c: Column, m: Column, key=key) -> Column:
            near = F.lit(True) if reach is None else key(c) - F.shiftright(m, 1) <= reach
            return (m.bitwiseAND(F.lit(1).cast("long")) == 1) & near

        cands = _against(cands, others, key, at, value, hit, True)
    return cands


def _left(cands: Column) -> Column:
    return plain(F.filter(cands, lambda c: ~c["ok"]))


def _hit(cands: Column) -> Column:
    return plain(F.filter(cands, lambda c: c["ok"]))


def written(found: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    parts = F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", parts)


def scan(docs: DataFrame, *, text: str = "text", into: str = "secrets", linking: Linking = Linking()) -> DataFrame:
    """``docs`` with a struct ``into``: base, weak and linked spans, and who is linked to what.

    ``base``: assign, access and hex spans by (start, kind). ``weak``: opaque
    tokens, apart from base spans, that have a partner; of a secret field or a part
    of an endpoint only the value. ``parts``: identifiers and endpoints, as (start, end). ``linked``: base spans with a partner. A null
    text counts as empty. Very long texts are read whole. Rows, repeated ones too, depend on their own text alone;
    an empty table gives an empty one. A column of the name ``into`` is replaced, all others stay, whatever their names.
    """
    names = fresh_names(docs, "t", "base", "ident", "end", "partner", "inline", "field", "opaque", "bound", "weak", "linked", keep=[into])
    t, base, ident, end, partner, inline, field, opaque, bound, weak, linked = (F.col(n) for n in names)
    n_t, n_base, n_ident, n_end, n_partner, n_inline, n_field, n_opaque, n_bound, n_weak, n_linked = names
    out = docs.withColumn(n_t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    out = out.withColumns({
        n_base: F.array_sort(F.concat(spans(t, ASSIGN, 0, lambda v: F.length(v) >= 8, 2), spans(t, ACCESS, 1), spans(t, HEX, 2))),
        n_ident: spans(t, IDENTIFIER, 4), n_end: spans(t, ENDPOINT, 5),
    })
    out = out.withColumn(n_partner, F.array_sort(F.concat(F.filter(base, lambda s: s["kind"] == 1), ident, end)))
    some = F.size(partner) > 0
    varied = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= linking.variety)
    query = _hit(inside(marked(spans(t, QUERY, 3, varied, 1, True)), end))
    out = out.withColumns({
        n_inline: F.when(F.size(end) > 0, F.concat(
            spans(t, USER, 3, varied, 1, True), spans(t, PASSWORD, 3, varied, 1, True), _left(meeting(marked(query), ident)),
        )).otherwise(_none()),
        n_field: F.when(some, spans(t, SECRET, 3, varied, 1, True)).otherwise(_none()),
        n_opaque: F.when(some, spans(t, OPAQUE, 3, varied)).otherwise(_none()),
        n_bound: F.when(some, spans(t, SCOPE_END, _BOUND)).otherwise(_none()),
    })
    loose = F.concat(
        _left(meeting(marked(field), F.concat(base, ident, inline, end))),
        _left(meeting(marked(opaque), F.concat(base, ident, end, field))),
    )
    assigned = F.filter(base, lambda s: s["kind"] != 1)
    out = out.withColumns({
        n_weak: F.when(some, F.array_sort(F.concat(
            _left(meeting(marked(inline), base)), _hit(joined(marked(loose), partner, bound, linking.reach)),
        ))).otherwise(_none()),
        n_linked: F.when(some, F.array_sort(_hit(joined(inside(marked(assigned), end), partner, bound, linking.reach)))).otherwise(_none()),
    })
    result = F.struct(
        base.alias("base"), weak.alias("weak"),
        F.transform(partner, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("parts"),
        linked.alias("linked"),
    )
    return out.withColumn(into, result).drop(*names)
