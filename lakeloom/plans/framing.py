"""GROUPS frames and frame exclusions, written as frames that Spark has.

A GROUPS frame is a RANGE frame over the dense rank of the order. A frame without some of its rows is two or three frames next to each
other, whose sums, counts and extremes are put together; where the part left out has no fixed bounds, sums and counts are subtracted.
"""

from __future__ import annotations

from lakeloom.plans.tokens import Token, closing, opening, render, significant, tokenize

_HEADS = {"PARTITION": "partition", "DISTRIBUTE": "partition", "ORDER": "order", "SORT": "order", "ROWS": "frame", "RANGE": "frame", "GROUPS": "frame", "EXCLUDE": "exclude"}


def _step(ts: list[Token], k: int, by: int) -> int:
    k += by
    while 0 <= k < len(ts) and ts[k].kind in ("space", "comment"):
        k += by
    return k


def _sections(ts: list[Token]) -> dict[str, list[Token]]:
    """The parts of a window's specification: partition, order, frame (its kind first) and exclude."""
    out, now, depth = {}, None, 0
    for t in ts:
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
        if not depth and t.kind == "word" and t.up in _HEADS and (_HEADS[t.up] != "frame" or "frame" not in out):
            now = _HEADS[t.up]
            out[now] = [t] if now == "frame" else []
        elif now is None and t.kind not in ("space", "comment"):
            return {}
        elif now and not (t.up == "BY" and t.kind == "word" and not significant(out[now])):
            out[now].append(t)
    return out


def _bound(words: list[Token]) -> int | str | None:
    """Offsets as numbers (preceding negative), 0 for the current row, None without bound; other offsets as text."""
    if words[0].up == "UNBOUNDED":
        return None
    if words[0].up == "CURRENT":
        return 0
    text = render([x for t in words[:-1] for x in (t, Token("space", " ", 0, 0))]).strip()
    if not text.isdigit():
        return f"{text} {words[-1].up}"
    return -int(text) if words[-1].up == "PRECEDING" else int(text)


def _frame(ts: list[Token]) -> tuple[str, int | str | None, int | str | None]:
    words = significant(ts)
    kind, rest = words[0].up, words[1:]
    if rest[0].up != "BETWEEN":
        return kind, _bound(rest), 0
    cut = next(i for i, t in enumerate(rest) if t.up == "AND")
    return kind, _bound(rest[1:cut]), _bound(rest[cut + 1 :])


def _offset(b: int | str | None, start: bool) -> str:
    if b is None:
        return "UNBOUNDED PRECEDING" if start else "UNBOUNDED FOLLOWING"
    return b if isinstance(b, str) else "CURRENT ROW" if b == 0 else f"{abs(b)} {'PRECEDING' if b < 0 else 'FOLLOWING'}"


def _plain_keys(order: list[Token]) -> str:
    """The expressions of an ORDER BY without their directions."""
    parts, now, depth = [], [], 0
    for t in significant(order):
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
        if t.kind == "op" and t.text == "," and not depth:
            parts.append(now)
            now = []
        else:
            now.append(t)
    out = []
    for p in [*parts, now]:
        while p and p[-1].kind == "word" and p[-1].up in ("ASC", "DESC", "FIRST", "LAST", "NULLS"):
            p = p[:-1]
        out.append(" ".join(t.text for t in p))
    return ", ".join(out)


class _Window:
    def __init__(self, sections: dict[str, list[Token]]):
        self.part, order = (render(sections.get(k, [])).strip() for k in ("partition", "order"))
        self.order, self.keys = order, _plain_keys(sections.get("order", [])) if order else ""
        by = f"PARTITION BY {self.part} " if self.part else ""
        self.rank = f"dense_rank() OVER ({by}ORDER BY {order})" if order else "1"

    def over(self, kind: str, lo, hi, peers: bool = False) -> str:
        """OVER (...): of a GROUPS frame by rank; ``peers``: within the rows of equal order."""
        part = ", ".join(x for x in (self.part, self.keys if peers else "") if x)
        order = self.rank if kind == "GROUPS" else self.order
        by = " ".join(x for x in (f"PARTITION BY {part}" if part else "", f"ORDER BY {order}" if order else "") if x)
        kind = "RANGE" if kind == "GROUPS" else kind
        return f"OVER ({by} {kind} BETWEEN {_offset(lo, True)} AND {_offset(hi, False)})"


def _before(lo, hi) -> bool:
    """Whether a frame has rows (or groups) between its bounds."""
    return lo is None or hi is None or lo <= hi


def _pieces(w: _Window, kind: str, lo, hi, exclude: str) -> list[str] | None:
    """Frames that make up the one without what is excluded; None if they have no fixed bounds."""
    if kind != "GROUPS" and (lo, hi) == (None, None) or kind == "RANGE" and lo in (None, 0) and hi in (None, 0):
        kind = "GROUPS"
    if isinstance(lo, str) or isinstance(hi, str) or kind == "RANGE" or kind == "ROWS" and exclude != "CURRENT ROW":
        return None
    out = []
    if _before(lo, -1 if hi is None else min(hi, -1)):
        out.append(w.over(kind, lo, -1 if hi is None else min(hi, -1)))
    if (lo is None or lo <= 0) and (hi is None or hi >= 0) and kind == "GROUPS":
        if exclude == "CURRENT ROW":
            out += [w.over("ROWS", None, -1, True), w.over("ROWS", 1, None, True)]
        elif exclude == "TIES":
            out.append(w.over("ROWS", 0, 0))
    if _before(1 if lo is None else max(lo, 1), hi):
        out.append(w.over(kind, 1 if lo is None else max(lo, 1), hi))
    return out


def _put_together(f: str, args: str, frames: list[str]) -> str:
    each = lambda g: [f"{g}({args}) {x}" for x in frames]
    if not frames:
        return "0L" if f == "count" else f"CAST(NULL AS {'DOUBLE' if f == 'avg' else 'BIGINT'})"
    if f == "count":
        return "(" + " + ".join(each("count")) + ")"
    if f == "sum":
        total = " + ".join(f"coalesce({x}, 0)" for x in each("sum"))
        return f"(CASE WHEN coalesce({', '.join(each('sum'))}) IS NOT NULL THEN {total} END)"
    if f in ("min", "max"):
        return each(f)[0] if len(frames) == 1 else f"{'least' if f == 'min' else 'greatest'}({', '.join(each(f))})"
    if f == "avg":
        return f"(CAST({_put_together('sum', args, frames)} AS DOUBLE) / nullif({_put_together('count', args, frames)}, 0))"
    raise ValueError(f"EXCLUDE with {f}: there are sum, count, avg, min and max")


def _less(f: str, args: str, w: _Window, kind: str, lo, hi, exclude: str) -> str:
    """Sums and counts of a frame, less what is excluded of it."""
    peers = w.over("ROWS", lo, hi, True) if kind == "ROWS" else w.over("ROWS", None, None, True)
    own, whole = w.over("ROWS", 0, 0), w.over(kind, lo, hi)
    inside = (lo is None or (lo.endswith("PRECEDING") if isinstance(lo, str) else lo <= 0)) and (hi is None or (hi.endswith("FOLLOWING") if isinstance(hi, str) else hi >= 0))
    gone = [peers] if exclude != "CURRENT ROW" and (inside or kind == "ROWS") else [own] if exclude == "CURRENT ROW" and inside else []
    back = [own] if exclude == "TIES" and inside else []

    def less(g: str) -> str:
        of = lambda x: f"coalesce({g}({args}) {x}, 0)"
        return "(" + of(whole) + "".join(f" - {of(x)}" for x in gone) + "".join(f" + {of(x)}" for x in back) + ")"

    if f == "count":
        return less("count")
    value = f"(CASE WHEN {less('count')} > 0 THEN {less('sum')} END)"
    if f == "sum":
        return value
    if f == "avg":
        return f"(CAST({value} AS DOUBLE) / nullif({less('count')}, 0))"
    raise ValueError(f"EXCLUDE {exclude} of a frame of rows or values with {f}: there are sum, count and avg")


def frames(ts: list[Token], c: object = None) -> list[Token]:
    """f(x) OVER (... GROUPS ... EXCLUDE ...), the window named or not, as frames that Spark has."""
    ts = _named(list(ts))
    k = 0
    while k < len(ts):
        if ts[k].up == "OVER" and ts[k].kind == "word" and (o := _step(ts, k, 1)) < len(ts) and ts[o].text == "(":
            z = closing(ts, o)
            s = _sections(ts[o + 1 : z])
            kind, lo, hi = _frame(s["frame"]) if s.get("frame") else ("", None, None)
            exclude = " ".join(t.up for t in significant(s.get("exclude", [])))
            exclude = "" if exclude == "NO OTHERS" else exclude
            if kind == "GROUPS" or "exclude" in s:
                w, p = _Window(s), _step(ts, k, -1)
                if not exclude:
                    ts[k : z + 1] = tokenize(w.over(kind, lo, hi))
                else:
                    a = opening(ts, p)
                    name = _step(ts, a, -1)
                    f, args = ts[name].text.lower(), render(ts[a + 1 : p]).strip()
                    if args.upper().startswith("DISTINCT "):
                        raise ValueError("EXCLUDE with DISTINCT")
                    got = _pieces(w, kind, lo, hi, exclude)
                    text = _less(f, args, w, kind, lo, hi, exclude) if got is None else _put_together(f, args, got)
                    ts[name : z + 1] = [Token("code", text, ts[name].start, ts[z].stop)]
                    k = name
        k += 1
    return ts


def _named(ts: list[Token]) -> list[Token]:
    """Named windows with such frames, put where they are used; their definitions go."""
    k = 0
    while k < len(ts):
        if ts[k].up == "WINDOW" and ts[k].kind == "word":
            items, at = [], k
            while True:
                name = _step(ts, at, 1)
                o = _step(ts, _step(ts, name, 1), 1)
                if o >= len(ts) or ts[_step(ts, name, 1)].up != "AS" or ts[o].text != "(":
                    break
                z = closing(ts, o)
                items.append((ts[name].text, ts[o : z + 1]))
                at, end = _step(ts, z, 1), z + 1
                if at >= len(ts) or ts[at].text != ",":
                    break
            special = {n.lower(): spec for n, spec in items if {"GROUPS", "EXCLUDE"} & {t.up for t in spec if t.kind == "word"}}
            if special:
                rest = [(n, spec) for n, spec in items if n.lower() not in special]
                text = "WINDOW " + ", ".join(f"{n} AS {render(spec)}" for n, spec in rest) if rest else ""
                ts[k:end] = tokenize(text)
                for i in range(len(ts) - 1, -1, -1):
                    n = _step(ts, i, 1)
                    if ts[i].up == "OVER" and ts[i].kind == "word" and n < len(ts):
                        z = closing(ts, n) if ts[n].text == "(" else n
                        used = "".join(t.text for t in significant(ts[n : z + 1])).strip("()").lower()
                        if used in special:
                            ts[n : z + 1] = special[used]
        k += 1
    return ts
