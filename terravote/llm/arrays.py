"""Array expressions whose work grows with the array's length, not its square.  All are SQL text over SQL text.

Lambda variables are numbered, so that expressions nest.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

#: Elements of a block, within which running results are appended one by one, and code points of a block of text.
BLOCK, CHARS = 128, 1024

_names = count()


def let(value: str, body: Callable[[str], str]) -> str:
    """body(value), with value computed once however often body uses it."""
    v = f"v{next(_names)}"
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def running(values: str, step: str = "a + x") -> str:
    """For each element of an array<bigint> the result of ``step`` over those before it, from 0 (``a + x``: sums).

    An append copies what is there, so only blocks are built by appends; the blocks' own results are carried on.
    """
    scan = lambda part, first: f"aggregate({part}, struct({first} as at, cast(array() as array<bigint>) as out), (s, x) -> struct(transform(array(s.at), a -> {step})[0] as at, array_append(s.out, s.at) as out)).out"
    total = lambda part: f"aggregate({part}, 0L, (a, x) -> {step})"

    def by_blocks(v: str) -> str:
        cut = f"transform(sequence(1, size({v}), {BLOCK}), b -> slice({v}, b, {BLOCK}))"
        return let(cut, lambda c: let(scan(f"transform({c}, b -> {total('b')})", "0L"), lambda h: f"flatten(zip_with({c}, {h}, (b, f) -> {scan('b', 'f')}))"))

    return let(values, lambda v: f"if(size({v}) = 0, cast(array() as array<bigint>), {by_blocks(v)})")


def rank(points: str, queries: str, inclusive: bool) -> str:
    """For each of the ascending queries, how many points lie before it (inclusive: or at it)."""
    p, q = (0, 3) if inclusive else (2, 1)  # points are even, and stand before or after the queries of their place
    events = f"sort_array(concat(transform({points}, x -> 4 * x + {p}), transform({queries}, x -> 4 * x + {q})))"
    return let(events, lambda e: f"filter({running(f'transform({e}, x -> 1 - x % 2)')}, (n, i) -> get({e}, i) % 2 = 1)")


def overlapped(spans: str, others: str) -> str:
    """For each span (struct start, end; ascending and disjoint) whether any other span, in whatever order, overlaps it."""
    begun, over = rank(f"{others}.start", f"{spans}.end", False), rank(f"{others}.end", f"{spans}.start", True)
    return f"if(size({spans}) = 0 or size({others}) = 0, transform({spans}, s -> false), zip_with({begun}, {over}, (b, o) -> b > o))"


def covered(spans: str, others: str) -> str:
    """For each span (struct start, end; ascending and disjoint) whether any one other span, in whatever order, covers it."""

    def reach(o: str) -> str:
        begun = rank(f"{o}.start", f"{spans}.start", True)
        ends = running(f"{o}.end", "greatest(a, x)")
        return let(begun, lambda b: let(ends, lambda e: f"zip_with({spans}, {b}, (s, n) -> coalesce(get({e}, int(n)), array_max({o}.end)) >= s.end)"))

    ordered = f"sort_array(transform({others}, o -> struct(o.start as start, o.end as end)))"
    return f"if(size({spans}) = 0 or size({others}) = 0, transform({spans}, s -> false), {let(ordered, reach)})"


def split_off(text: str, pattern: str) -> str:
    """array<string>: text between, match, text between, ..., text between, for a pattern's leftmost matches.

    The text is searched once: matches are set between two marks and cut there.  A mark in the text itself becomes the
    next control character, which the patterns here don't tell from it.
    """
    plain = f"if(contains({text}, char(1)), translate({text}, char(1), char(2)), {text})"
    return rf"split(regexp_replace({plain}, r'{pattern}', concat(char(1), r'$0', char(1))), char(1), -1)"


def matches(text: str, pattern: str, may: str, context: int = 0) -> str:
    """array<struct<start, end, value[, before, after]>> of the leftmost matches; texts without ``may`` are not searched.

    before and after are up to ``context`` code points around the match, back and forth to the end of the next match at most.
    """
    kind = "struct<start:bigint,end:bigint,value:string" + (",before:string,after:string>" if context else ">")

    def one(p: str, at: str) -> str:
        near = lambda a, b: f"concat(coalesce(get({p}, {a}), ''), coalesce(get({p}, {b}), ''))"
        around = f", right({near('i - 2', 'i - 1')}, {context}) as before, left({near('i + 1', 'i + 2')}, {context}) as after" if context else ""
        return f"struct(get({at}, i) as start, get({at}, i) + char_length(get({p}, i)) as end, get({p}, i) as value{around})"

    def each(p: str) -> str:
        return let(running(f"transform({p}, x -> bigint(char_length(x)))"), lambda at: f"transform(sequence(1, size({p}) - 2, 2), i -> {one(p, at)})")

    none = f"cast(array() as array<{kind}>)"
    cut = let(split_off(text, pattern), lambda p: f"if(size({p}) > 1, {each(p)}, {none})")
    return f"if({may}, {cut}, {none})"


def replaced(text: str, spans: str, labels: list[str]) -> str:
    """text with the spans (struct start, end, order; any order) replaced by labels[order].

    Spans that overlap are replaced together, by the label of the first.  The text is cut into blocks once, so a piece is
    found without reading the text from its beginning.
    """
    names = "array(" + ", ".join(f"'{x}'" for x in labels) + ")"

    def regions(s: str) -> str:
        def heads(reach: str) -> str:
            first = f"filter(sequence(0, size({s}) - 1), i -> get({s}, i).start >= get({reach}, i))"
            return let(first, lambda h: f"transform({h}, (i, k) -> struct(get({s}, i).start as start, coalesce(get({reach}, get({h}, k + 1)), array_max({s}.end)) as end, get({names}, get({s}, i).order) as label))")

        return let(running(f"{s}.end", "greatest(a, x)"), heads)

    def piece(blocks: str, a: str, b: str) -> str:
        i, j = f"int({a} div {CHARS})", f"int({b} div {CHARS})"
        same = f"substring(get({blocks}, {i}), int({a} % {CHARS}) + 1, int({b} - {a}))"
        far = f"concat(substring(get({blocks}, {i}), int({a} % {CHARS}) + 1, {CHARS}), array_join(slice({blocks}, {i} + 2, {j} - {i} - 1), ''), coalesce(substring(get({blocks}, {j}), 1, int({b} % {CHARS})), ''))"
        return f"case when {a} >= {b} then '' when {i} = {j} then {same} else {far} end"

    def write(r: str, b: str) -> str:
        parts = let(f"transform({r}, (x, k) -> struct(coalesce(get({r}, k - 1).end, 0L) as a, x.start as b, x.label as label))", lambda g: f"flatten(transform({g}, x -> array({piece(b, 'x.a', 'x.b')}, x.label)))")
        return let(f"struct(get({r}, size({r}) - 1).end as a, bigint(char_length({text})) as b)", lambda t: f"concat(array_join({parts}, ''), {piece(b, f'{t}.a', f'{t}.b')})")

    ordered = f"sort_array(transform({spans}, s -> struct(s.start as start, s.end as end, s.order as order)))"
    blocks = rf"regexp_extract_all({text}, r'(?s).{{1,{CHARS}}}', 0)"
    run = let(ordered, lambda s: let(regions(s), lambda r: let(blocks, lambda b: write(r, b))))
    return f"if(size({spans}) > 0, {run}, {text})"
