"""Signature text: arity, normalisation and the change ladder.

The scanners are folds over an array of characters or tokens inside ``aggregate``. They run only where a
caller's ``when`` reaches them, which in a snapshot diff is the few symbols whose text differs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

IDENTIFIER = r"[A-Za-z_$][\w$]*"


def normalise_signature(text: Column) -> Column:
    """Reduce cached module paths to package and subpath, drop import wrappers, collapse whitespace; no text is cut."""
    quoted_path = r"""(["'])[^"']*?/cache/([^/"']+)/[^/"']+/package/([^"']*)\1"""
    out = F.regexp_replace(text, quoted_path, "$1$2/$3$1")
    out = F.regexp_replace(out, r"""import\((?:"[^"]*"|'[^']*')\)\.""", "")
    return strip(F.regexp_replace(out, r"\s+", " "))


# The folds below are SQL text: one parsed expression instead of hundreds of calls to build it. ``{s}`` is the text.

_CHARACTERS = "filter(split({s}, ''), c -> c <> '')"

# Where the parenthesis that opens first is closed again, counted from its own position; 0 where it never is.
_CLOSING = (
    "aggregate(" + _CHARACTERS + ", named_struct('depth', 0, 'seen', 0, 'end', 0), (a, c) -> named_struct("
    "'depth', a.depth + CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, 'seen', a.seen + 1, "
    "'end', CASE WHEN a.end = 0 AND c = ')' AND a.depth = 1 THEN a.seen + 1 ELSE a.end END)).end"
)

_NEST = "(a.nest + CASE WHEN c IN ('(', '<', '{{', '[') THEN 1 WHEN c IN (')', '>', '}}', ']') THEN -1 ELSE 0 END)"
_MUST_PASS = "NOT (ltrim(a.text) LIKE '...%' OR rtrim(CASE WHEN a.colon THEN a.label ELSE a.text END) LIKE '%?')"
_ARITY = (
    "aggregate(" + _CHARACTERS + ", named_struct('nest', 0, 'text', '', 'label', '', 'colon', false, 'need', 0), "
    f"(a, c) -> named_struct('nest', {_NEST}, "
    f"'text', CASE WHEN c = ',' AND {_NEST} = 0 THEN '' ELSE concat(a.text, c) END, "
    f"'label', CASE WHEN c = ',' AND {_NEST} = 0 THEN '' WHEN a.colon OR (c = ':' AND {_NEST} = 0) THEN a.label ELSE concat(a.label, c) END, "
    f"'colon', NOT (c = ',' AND {_NEST} = 0) AND (a.colon OR (c = ':' AND {_NEST} = 0)), "
    f"'need', a.need + CASE WHEN c = ',' AND {_NEST} = 0 AND {_MUST_PASS} THEN 1 ELSE 0 END), "
    f"a -> a.need + CASE WHEN trim(a.text) <> '' AND {_MUST_PASS} THEN 1 ELSE 0 END)"
)


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def arity_sql(signature: str) -> str:
    """SQL text: how many top-level parameters must be passed; NULL where the text has no parameter list.

    Bracket depth counts ``>`` of an arrow too, as the compared results do, so a parameter of function type
    hides the commas after it.
    """
    tail = f"CASE WHEN instr({signature}, '(') > 0 THEN substring({signature}, instr({signature}, '(')) END"
    inner = _let("closing", _CLOSING.format(s="tail"), "CASE WHEN closing > 0 THEN trim(substring(tail, 2, closing - 2)) END")
    return _let("tail", tail, _let("inner", inner, _ARITY.format(s="inner")))


def required_arity(signature: str) -> Column:
    return F.expr(arity_sql(signature))


# Tokens: an arrow, a name with its colon, a bare name, or any single character.
_TOKEN = r"=>| *(?:\\.\\.\\.)?[A-Za-z_$][\\w$]*\\??:|[A-Za-z_$][\\w$]*|[\\s\\S]"
_BINDING = r"^(?:\\.\\.\\.)?[A-Za-z_$][\\w$]*\\??:$"
_FRAME = "struct<open:string,count:int,start:int,rest:string>"
_TOP = "get(a.stack, size(a.stack) - 1)"
_POP = "slice(a.stack, 1, greatest(size(a.stack) - 1, 0))"
_IN_CALL = f"(a.fresh AND {_TOP}.open = '(')"
_BINDS = f"({_IN_CALL} AND ltrim(c) RLIKE '{_BINDING}')"
_SLOT = f"concat('p', cast({_TOP}.count AS string))"
# the colon, or the question mark before it, right after a closed destructuring pattern
_ENDS = "(a.shut >= 0 AND c = ':')"
_MAY_END = "(a.shut >= 0 AND c = '?' AND a.mark = '')"
_OPENS, _CLOSES = "c IN ('(', '{', '[', '<')", "c IN (')', '}', ']', '>')"
_PATTERN = f"({_IN_CALL} AND c IN ('{{', '['))"
_LEAD = r"regexp_extract(a.out, '( *(?:\\.\\.\\.)?)$', 1)"
_BUMPED = (
    f"concat({_POP}, array(named_struct('open', {_TOP}.open, 'count', {_TOP}.count + 1, 'start', {_TOP}.start, 'rest', {_TOP}.rest)))"
)
_PUSHED = (
    f"concat(a.stack, array(named_struct('open', c, 'count', 0, 'start', CASE WHEN {_PATTERN} THEN length(a.out) - length({_LEAD}) ELSE -1 END, "
    f"'rest', CASE WHEN {_PATTERN} AND {_LEAD} LIKE '%...' THEN '...' ELSE '' END)))"
)
_CLOSED = f"({_CLOSES} AND {_TOP}.start >= 0)"


def positional_sql(signature: str) -> str:
    """SQL text: parameter names replaced by their position, inside parenthesised groups only.

    A fold over tokens with a stack of open brackets. A ``{`` or ``[`` where a parameter starts may be a
    destructuring pattern: where it closes right before the colon, the whole pattern becomes a position.
    """
    return (
        f"aggregate(regexp_extract_all({signature}, '{_TOKEN}', 0), "
        f"named_struct('out', '', 'stack', cast(array() AS array<{_FRAME}>), 'fresh', false, 'shut', -1, 'shut_rest', '', 'mark', ''), "
        f"(a, c) -> named_struct("
        f"'out', CASE WHEN {_BINDS} THEN concat(a.out, CASE WHEN ltrim(c) LIKE '...%' THEN '...' ELSE '' END, {_SLOT}, CASE WHEN c LIKE '%?:' THEN '?' ELSE '' END, ':') "
        f"WHEN {_ENDS} THEN concat(substring(a.out, 1, a.shut), a.shut_rest, {_SLOT}, a.mark, ':') ELSE concat(a.out, c) END, "
        f"'stack', CASE WHEN {_BINDS} OR {_ENDS} THEN {_BUMPED} WHEN {_OPENS} THEN {_PUSHED} WHEN {_CLOSES} THEN {_POP} ELSE a.stack END, "
        f"'fresh', CASE WHEN {_BINDS} OR {_ENDS} THEN false WHEN c IN ('(', ',') THEN true WHEN {_OPENS} OR {_CLOSES} THEN false "
        f"ELSE a.fresh AND (c IN (' ', '.') OR {_MAY_END}) END, "
        f"'shut', CASE WHEN {_CLOSED} THEN {_TOP}.start WHEN {_MAY_END} THEN a.shut ELSE -1 END, "
        f"'shut_rest', CASE WHEN {_CLOSED} THEN {_TOP}.rest WHEN {_MAY_END} THEN a.shut_rest ELSE '' END, "
        f"'mark', CASE WHEN {_MAY_END} THEN '?' ELSE '' END), a -> a.out)"
    )


def positional_params(signature: str) -> Column:
    return F.expr(positional_sql(signature))


def without_printer_suffixes(signature: Column) -> Column:
    """``Name_2`` printed to tell two equal names apart, back to ``Name``."""
    return F.regexp_replace(signature, rf"\b([A-Za-z_$][\w$]*?)_\d+\b", "$1")


_QUOTED = r"replace(p.name, '$', '\\\\$')"


def type_positions_sql(signature: str, type_params: str) -> str:
    """SQL text: type parameter names replaced by their position."""
    return (
        f"aggregate(transform(coalesce({type_params}, array()), (p, i) -> named_struct('name', p.name, 'i', i)), {signature}, "
        r"(t, p) -> regexp_replace(t, concat('\\b', " + _QUOTED + r", '\\b'), concat('T', cast(p.i AS string))))"
    )


def comparable_sql(signature: str, type_params: str) -> str:
    """SQL text: the form in which two versions of a symbol are compared, before printer suffixes go."""
    return positional_sql(type_positions_sql(signature, type_params))


def comparable_signature(signature: str, type_params: str) -> Column:
    return without_printer_suffixes(F.expr(comparable_sql(signature, type_params)))


def change_class_sql(before_params: str, after_params: str, before: str, after: str) -> str:
    """SQL text: (severity, confidence) of a changed signature.

    Widened only by type parameters that have defaults: a feature. More parameters, or more type parameters
    without default, that must be passed: breaking. Anything else: drift.
    """
    had, has = f"coalesce({before_params}, array())", f"coalesce({after_params}, array())"
    added = f"slice({has}, size({had}) + 1, greatest(size({has}) - size({had}), 0))"
    grows = f"size({has}) > size({had})"
    same_start = f"transform(slice({has}, 1, size({had})), p -> p.name) = transform({had}, p -> p.name)"
    reduced = (
        f"aggregate({added}, {after}, (t, p) -> regexp_replace(t, concat(',\\\\s*', {_QUOTED}, '(\\\\s*=\\\\s*[^,>]+)?(?=\\\\s*[,>])'), ''))"
    )
    widened = f"({grows} AND {same_start} AND forall({added}, p -> p.defaulted) AND {reduced} = {before})"
    gained = f"(coalesce({arity_sql(after)} > {arity_sql(before)}, false) OR ({grows} AND exists({added}, p -> NOT p.defaulted)))"
    kind = f"CASE WHEN {widened} THEN 'feature' WHEN {gained} THEN 'breaking' ELSE 'drift' END"
    return _let("severity", kind, "named_struct('severity', severity, 'confidence', CASE severity WHEN 'drift' THEN 'medium' ELSE 'high' END)")


def signature_change_class(before_params: str, after_params: str, before: str, after: str) -> Column:
    return F.expr(change_class_sql(before_params, after_params, before, after))


def names_own_declaration(signature: Column, path: Column) -> Column:
    """``typeof X`` where X is the symbol's own last segment."""
    named = F.regexp_extract(strip(signature), rf"^typeof ({IDENTIFIER})$", 1)
    return (named != "") & (named == F.element_at(F.split(path, r"\."), -1))


def is_typeof(signature: Column) -> Column:
    return strip(signature).rlike(rf"^typeof {IDENTIFIER}$")
