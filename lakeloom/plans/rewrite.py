"""The dialect's syntax that Spark SQL does not accept, rewritten token by token.

Each rule takes the list of tokens and returns a new one; what no rule touches stays as written. Rules that need more than
text (a table's size, session variables) take it from the ``context``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from lakeloom.plans.framing import frames
from lakeloom.plans.tokens import FULL_WIDTH, Token, closing, opening, render, significant, tokenize


@dataclass
class Context:
    """What rewriting may need: parameter values, names of table variables, a table's size in bytes."""

    params: dict[str, object] = field(default_factory=dict)
    tables: set[str] = field(default_factory=set)
    scalars: set[str] = field(default_factory=set)
    table_bytes: Callable[[str], int | None] = lambda name: None
    scan: Callable[[str, dict[str, str]], str] = lambda name, options: name
    zorder: list[str] = field(default_factory=list)


def _t(text: str, like: Token | None = None) -> Token:
    at = like.start if like else 0
    return Token("code", text, at, like.stop if like else at)


def _next(ts: list[Token], k: int) -> int:
    """The next significant token after k (or len)."""
    k += 1
    while k < len(ts) and ts[k].kind in ("space", "comment"):
        k += 1
    return k


def _prev(ts: list[Token], k: int) -> int:
    k -= 1
    while k >= 0 and ts[k].kind in ("space", "comment"):
        k -= 1
    return k


def _is(ts: list[Token], k: int, *texts: str) -> bool:
    return 0 <= k < len(ts) and ts[k].kind in ("word", "op") and ts[k].up in texts


def _split(ts: list[Token], sep: str = ",") -> list[list[Token]]:
    out, now, depth = [], [], 0
    for t in ts:
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
        if t.kind == "op" and t.text == sep and not depth:
            out.append(now)
            now = []
        else:
            now.append(t)
    return [*out, now]


def full_width(ts: list[Token], c: Context) -> list[Token]:
    return [Token("op", FULL_WIDTH[t.text], t.start, t.stop) if t.text in FULL_WIDTH else t for t in ts]


def parameters(ts: list[Token], c: Context) -> list[Token]:
    """${name}: the value given for it; also inside a name, as in t_${day}."""
    return [_t(str(c.params[t.text[2:-1].strip()]), t) if t.kind == "param" and t.text[2:-1].strip() in c.params else t for t in ts]


def charset_strings(ts: list[Token], c: Context) -> list[Token]:
    out = []
    for t in ts:
        if t.kind == "string" and t.text[0] == "_":
            cut = min(i for i in (t.text.find("'"), t.text.find('"')) if i >= 0)
            t = Token("string", t.text[cut:], t.start + cut, t.stop)
        elif t.kind == "charset":
            t = _t(f"X'{t.text.split()[-1][2:]}'", t)
        out.append(t)
    return out


def typed_words(ts: list[Token], c: Context) -> list[Token]:
    """DATETIME as a literal's or a column's type, LOCALTIMESTAMP without brackets."""
    out = list(ts)
    for k, t in enumerate(ts):
        n = _next(ts, k)
        p = _prev(ts, k)
        if t.up == "DATETIME" and (n < len(ts) and ts[n].kind == "string" or _is(ts, p, "AS") and _is(ts, n, ")", ",") or _is(ts, p, "<", ",", ":") and _is(ts, n, ">", ",")):
            out[k] = _t("TIMESTAMP", t)
        elif t.up == "LOCALTIMESTAMP" and not _is(ts, n, "(") and not _is(ts, p, ".", "AS"):
            out[k] = _t("localtimestamp()", t)
    return out


def limit_pair(ts: list[Token], c: Context) -> list[Token]:
    """LIMIT m, n -> LIMIT n OFFSET m."""
    out, k = [], 0
    while k < len(ts):
        if ts[k].up == "LIMIT" and ts[k].kind == "word":
            end, depth = k + 1, 0
            while end < len(ts):
                if ts[end].kind == "op":
                    depth += (ts[end].text == "(") - (ts[end].text == ")")
                if depth < 0 or ts[end].kind == "op" and ts[end].text == ";" or ts[end].up in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
                    break
                end += 1
            parts = _split(ts[k + 1 : end])
            if len(parts) == 2:
                tail = [t for t in parts[1] if t.kind == "comment"]
                first, count = (render([t for t in p if t.kind != "comment"]).strip() for p in parts)
                out += [ts[k], _t(f" {count} OFFSET {first} ", ts[k]), *tail]
                k = end
                continue
        out.append(ts[k])
        k += 1
    return out


def several_on(ts: list[Token], c: Context) -> list[Token]:
    """JOIN b ON x ON y -> JOIN b ON (x) AND (y)."""
    stops = {"JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "WHERE", "GROUP", "HAVING", "ORDER", "SORT", "DISTRIBUTE", "CLUSTER", "ZORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "LATERAL", "WHEN", "USING"}
    out, k = [], 0
    while k < len(ts):
        if ts[k].kind == "word" and ts[k].up == "ON":
            end, depth, cuts = k + 1, 0, []
            while end < len(ts):
                t = ts[end]
                if t.kind == "op":
                    depth += (t.text in "([") - (t.text in ")]")
                if depth < 0 or not depth and (t.kind == "word" and t.up in stops and not (t.up in ("LEFT", "RIGHT") and _is(ts, _next(ts, end), "(")) or t.kind == "op" and t.text in ",;"):
                    break
                if not depth and t.kind == "word" and t.up == "ON":
                    cuts.append(end)
                end += 1
            if cuts:
                parts = [ts[a + 1 : b] for a, b in zip([k, *cuts], [*cuts, end])]
                out += [ts[k], _t(" " + " AND ".join(f"({render(p).strip()})" for p in parts) + " ", ts[k])]
                k = end
                continue
        out.append(ts[k])
        k += 1
    return out


def filter_over(ts: list[Token], c: Context) -> list[Token]:
    """f(x) FILTER (WHERE p) OVER ... -> f(CASE WHEN p THEN x END) OVER ..."""
    k = 0
    ts = list(ts)
    while k < len(ts):
        if ts[k].up == "FILTER" and _is(ts, n := _next(ts, k), "("):
            z = closing(ts, n)
            p = _prev(ts, k)
            if _is(ts, _next(ts, z), "OVER") and _is(ts, p, ")"):
                a = opening(ts, p)
                inner = ts[a + 1 : p]
                words = significant(inner)
                distinct = "DISTINCT " if words and words[0].up == "DISTINCT" else ""
                args = _split(inner[inner.index(words[0]) + 1 :] if distinct else inner)
                first = render(args[0]).strip()
                cond = render(ts[_next(ts, n) + 1 : z]).strip()
                rest = "".join("," + render(x) for x in args[1:])
                ts[a + 1 : z + 1] = [_t(f"{distinct}CASE WHEN {cond} THEN {'1' if first == '*' else first} END{rest})", ts[k])]
                k = a
        k += 1
    return ts


def extended_windows(ts: list[Token], c: Context) -> list[Token]:
    """OVER (w ORDER BY x): the named window's own text in place of w."""
    named: dict[str, str] = {}
    for k, t in enumerate(ts):
        if t.up == "AS" and _is(ts, n := _next(ts, k), "(") and (p := _prev(ts, k)) >= 0 and ts[p].kind in ("word", "quoted"):
            q = _prev(ts, p)
            if _is(ts, q, "WINDOW") or _is(ts, q, ",") and named:
                named[ts[p].text.strip("`").lower()] = render(ts[n + 1 : closing(ts, n)]).strip()
    out = list(ts)
    for k, t in enumerate(ts):
        if t.up in ("OVER", "AS") and t.kind == "word" and _is(ts, n := _next(ts, k), "("):
            m = _next(ts, n)
            if ts[m].kind in ("word", "quoted") and ts[m].text.strip("`").lower() in named and not _is(ts, _next(ts, m), ")", "(") and ts[m].up not in ("PARTITION", "ORDER"):
                if t.up == "OVER" or _is(ts, _prev(ts, _prev(ts, k)), "WINDOW", ","):
                    out[m] = _t(named[ts[m].text.strip("`").lower()], ts[m])
    return out


def xor_precedence(ts: list[Token], c: Context) -> list[Token]:
    """a ^ b binds tighter than any other operator of two operands: (a ^ b)."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if ts[k].kind == "op" and ts[k].text == "^":
            a = _prev(ts, k)
            if _is(ts, a, ")", "]"):
                a = opening(ts, a)
            while True:
                p = _prev(ts, a)
                if p >= 0 and (_is(ts, p, ".") or ts[a].text in "([" and ts[p].kind in ("word", "quoted") and ts[p].up not in ("SELECT", "AND", "OR", "NOT", "IN", "WHERE", "ON", "BY", "WHEN", "THEN", "ELSE")):
                    a = _prev(ts, p) if _is(ts, p, ".") else p
                else:
                    break
            z = _next(ts, k)
            while _is(ts, z, "-", "+", "~"):
                z = _next(ts, z)
            while True:
                n = _next(ts, z)
                if _is(ts, z, "("):
                    z = closing(ts, z)
                elif _is(ts, n, "(", "["):
                    z = closing(ts, n)
                elif _is(ts, n, "."):
                    z = _next(ts, n)
                    continue
                if not _is(ts, _next(ts, z), "[", "."):
                    break
            done = _t("(" + render(ts[a : z + 1]).replace("^", "\x00") + ")", ts[k])
            ts[a : z + 1] = [done]
            k = a
            if _is(ts, _next(ts, k), "^"):
                ts[k] = Token("quoted", done.text, done.start, done.stop)
        k += 1
    return [Token(t.kind, t.text.replace("\x00", "^"), t.start, t.stop) if "\x00" in t.text else t for t in ts]


def bucket_sample(ts: list[Token], c: Context) -> list[Token]:
    """t TABLESAMPLE (BUCKET n OUT OF m ON e, ...) -> a filter on the hash of e; (10M) -> a share of the table's bytes."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if ts[k].up == "TABLESAMPLE" and _is(ts, n := _next(ts, k), "("):
            z = closing(ts, n)
            inner = significant(ts[n + 1 : z])
            words = [t.up for t in inner]
            p = _prev(ts, k)
            a = p
            while _is(ts, _prev(ts, a), "."):
                a = _prev(ts, _prev(ts, a))
            if words[:1] == ["BUCKET"] and "ON" in words:
                on = words.index("ON")
                exprs = render([x for t in inner[on + 1 :] for x in (t, _t(" "))]).strip()
                share = f"(SELECT * FROM {render(ts[a : p + 1])} WHERE pmod(hash({exprs}), {inner[4].text}) = {int(inner[1].text) - 1})"
                ts[a : z + 1] = [_t(share, ts[k])]
                k = a
            elif len(inner) == 1 and inner[0].kind == "size":
                unit = {"b": 0, "k": 10, "m": 20, "g": 30}[inner[0].text[-1].lower()]
                want = float(inner[0].text[:-1]) * (1 << unit)
                have = c.table_bytes(render(ts[a : p + 1]))
                percent = 100.0 if not have else min(100.0, 100.0 * want / have)
                ts[n + 1 : z] = [_t(f"{percent:.6f} PERCENT", inner[0])]
        k += 1
    return ts


def hints(ts: list[Token], c: Context) -> list[Token]:
    """Hints after FROM move to their SELECT; SKEWJOIN goes, since adaptive execution splits skewed joins by itself."""
    ts = list(ts)
    for k, t in enumerate(ts):
        if t.kind != "hint":
            continue
        items = [render(p).strip() for p in _split(tokenize(t.text[3:-2]))]
        kept = [x for x in items if x and not x.upper().startswith("SKEWJOIN")]
        text = f"/*+ {', '.join(kept)} */" if kept else ""
        if _is(ts, _prev(ts, k), "FROM"):
            depth, j = 0, _prev(ts, k)
            while j >= 0:
                if ts[j].kind == "op":
                    depth += (ts[j].text == ")") - (ts[j].text == "(")
                if ts[j].up == "SELECT" and not depth:
                    ts[j] = _t(f"{ts[j].text} {text}", ts[j])
                    break
                j -= 1
            text = ""
        ts[k] = Token("hint" if text else "space", text or " ", t.start, t.stop)
    return ts


_UNITS = {"YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "YEARS", "MONTHS", "WEEKS", "DAYS", "HOURS", "MINUTES", "SECONDS"}


def interval_expressions(ts: list[Token], c: Context) -> list[Token]:
    """INTERVAL (e) DAY and INTERVAL c DAY -> (e) * INTERVAL '1' DAY."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if ts[k].up == "INTERVAL" and ts[k].kind == "word":
            n = _next(ts, k)
            z = closing(ts, n) if _is(ts, n, "(") else n
            while _is(ts, _next(ts, z), "."):
                z = _next(ts, _next(ts, z))
            u = _next(ts, z)
            if n < len(ts) and ts[n].kind in ("word", "op", "quoted") and _is(ts, u, *_UNITS):
                ts[k : u + 1] = [_t(f"(({render(ts[n : z + 1])}) * INTERVAL '1' {ts[u].text})", ts[k])]
        k += 1
    return ts


def lambda_functions(ts: list[Token], c: Context) -> list[Token]:
    """FUNCTION(@x, @y) AS e -> (x, y) -> e, within the call that has it for an argument."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if ts[k].up == "FUNCTION" and _is(ts, n := _next(ts, k), "(") and _is(ts, _next(ts, z := closing(ts, n)), "AS"):
            names = [t.text for t in significant(ts[n + 1 : z]) if t.text[0] == "@"]
            e, depth = _next(ts, z) + 1, 0
            end = e
            while end < len(ts):
                if ts[end].kind == "op":
                    depth += (ts[end].text in "([") - (ts[end].text in ")]")
                if depth < 0 or not depth and ts[end].kind == "op" and ts[end].text == ",":
                    break
                end += 1
            body = [Token("word", t.text[1:], t.start, t.stop) if t.text in names else t for t in ts[e:end]]
            head = ", ".join(x[1:] for x in names)
            ts[k:end] = [_t(f"{head if len(names) == 1 else f'({head})'} -> {render(body).strip()}", ts[k])]
        k += 1
    return ts


#: Functions that may be called as methods of a value.
METHODS = frozenset("length substr substring upper lower trim concat replace contains startswith endswith size split tolowercase touppercase".split())
_RENAMED = {"tolowercase": "lower", "touppercase": "upper"}


def method_calls(ts: list[Token], c: Context) -> list[Token]:
    """x.f(a) -> f(x, a) for the functions of METHODS."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if _is(ts, k, ".") and (n := _next(ts, k)) < len(ts) and ts[n].text.lower() in METHODS and _is(ts, _next(ts, n), "("):
            o = _next(ts, n)
            z, a = closing(ts, o), _prev(ts, k)
            if _is(ts, a, ")"):
                a = opening(ts, a)
                if _prev(ts, a) >= 0 and ts[_prev(ts, a)].kind == "word" and ts[_prev(ts, a)].up not in ("SELECT", "WHERE", "AND", "OR", "ON", "BY", "THEN", "ELSE", "WHEN"):
                    a = _prev(ts, a)
            while _is(ts, _prev(ts, a), "."):
                a = _prev(ts, _prev(ts, a))
            name = _RENAMED.get(ts[n].text.lower(), ts[n].text)
            args = render(ts[o + 1 : z]).strip()
            ts[a : z + 1] = [Token("quoted", f"{name}({render(ts[a:k])}{', ' if args else ''}{args})", ts[a].start, ts[z].stop)]
            k = a
        k += 1
    return ts


def qualified_functions(ts: list[Token], c: Context) -> list[Token]:
    """db:f(x) and ::f(x) -> f(x)."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if _is(ts, k, ":", "::") and (n := _next(ts, k)) < len(ts) and ts[n].kind == "word" and _is(ts, _next(ts, n), "("):
            p = _prev(ts, k)
            glued = ts[k].text == ":" and p == k - 1 and ts[p].kind == "word"
            if glued or ts[k].text == "::" and (p < 0 or ts[p].kind == "op" or ts[p].up in ("SELECT", "WHERE", "AND", "OR", "BY", "ON")):
                a = p if glued else k
                ts[a:n] = []
                k = a
        k += 1
    return ts


def renamed_functions(ts: list[Token], c: Context) -> list[Token]:
    """Calls of functions that Spark has under another name or shape."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        name = ts[k].text.lower() if ts[k].kind == "word" else ""
        if name in _SHAPES and _is(ts, n := _next(ts, k), "(") and not _is(ts, _prev(ts, k), "."):
            z = closing(ts, n)
            inner = renamed_functions(ts[n + 1 : z], c)
            args = [render(a).strip() for a in _split(inner)]
            made = _SHAPES[name]([a for a in args if a])
            if made is not None:
                ts[k : z + 1] = [_t(made, ts[k])]
        k += 1
    return ts


def numeric_trunc(x: str, d: str) -> str:
    """Digits beyond the d-th cut off, towards zero."""
    return f"(sign({x}) * floor(abs({x}) * pow(10, {d})) / pow(10, {d}))"


def _group_concat(args: list[str]) -> str:
    distinct = ""
    if args[0].upper().startswith("DISTINCT "):
        distinct, args = "DISTINCT ", [args[0][9:], *args[1:]]
    sep = args[1] if len(args) > 1 else "','"
    value = f"CAST({args[0]} AS STRING)"
    return f"listagg({distinct}{value}, {sep}) WITHIN GROUP (ORDER BY {value})"


def _convert(args: list[str]) -> str | None:
    return f"CAST({args[0]} AS {args[1]})" if len(args) == 2 else None


_SHAPES: dict[str, Callable[[list[str]], str | None]] = {
    "group_concat": _group_concat,
    "truncate": lambda a: numeric_trunc(a[0], a[1] if len(a) > 1 else "0"),
    "trunc": lambda a: None if len(a) > 1 and a[1][:1] in "'\"" else numeric_trunc(a[0], a[1] if len(a) > 1 else "0"),
    "week": lambda a: f"weekofyear({a[0]})",
    "convert": _convert,
    "to_number": lambda a: f"try_cast({a[0]} AS DECIMAL(38,18))" if len(a) == 1 else None,
    "to_string": lambda a: f"CAST({a[0]} AS STRING)" if len(a) == 1 else None,
}


def variables(ts: list[Token], c: Context) -> list[Token]:
    """@v of a table variable: its view; of a scalar one: its session variable."""
    out = []
    for t in ts:
        if t.kind == "word" and t.text[0] == "@":
            name = t.text.lstrip("@")
            if name.lower() in c.tables or name.lower() in c.scalars:
                t = Token("word", name, t.start, t.stop)
        out.append(t)
    return out


def zorder(ts: list[Token], c: Context) -> list[Token]:
    """ZORDER BY a, b goes from the text; the engine lays the rows out by it."""
    out, k = [], 0
    while k < len(ts):
        if ts[k].up == "ZORDER" and _is(ts, b := _next(ts, k), "BY"):
            end, depth = b + 1, 0
            while end < len(ts) and not (ts[end].kind == "op" and ts[end].text == ";") and ts[end].up != "LIMIT":
                depth += (ts[end].text == "(") - (ts[end].text == ")")
                if depth < 0:
                    break
                end += 1
            c.zorder[:] = [render(x).strip() for x in _split(ts[b + 1 : end])]
            k = end
            continue
        out.append(ts[k])
        k += 1
    return out


def unique_join(ts: list[Token], c: Context) -> list[Token]:
    """FROM UNIQUEJOIN [PRESERVE] a (k), [PRESERVE] b (k) -> a chain of joins on k: full where both sides are preserved."""
    ts = list(ts)
    for k, t in enumerate(ts):
        if t.up == "UNIQUEJOIN" and t.kind == "word":
            end, depth = k + 1, 0
            while end < len(ts):
                depth += (ts[end].text == "(") - (ts[end].text == ")") if ts[end].kind == "op" else 0
                if depth < 0 or not depth and ts[end].up in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "SELECT"):
                    break
                end += 1
            sides = []
            for part in _split(ts[k + 1 : end]):
                sig = significant(part)
                keep = sig[0].up == "PRESERVE"
                o = max(i for i, x in enumerate(sig) if x.text == "(" and i)
                table = " ".join(x.text for x in sig[keep:o])
                alias = sig[o - 1].text
                keys = ["".join(x.text for x in kk) for kk in _split(sig[o + 1 : -1])]
                sides.append((keep, table, [x if "." in x else f"{alias}.{x}" for x in keys]))
            text, held, kept = f" {sides[0][1]}", sides[0][2], sides[0][0]
            for keep, table, keys in sides[1:]:
                kind = "FULL OUTER" if kept and keep else "LEFT OUTER" if kept else "RIGHT OUTER" if keep else "INNER"
                text += f" {kind} JOIN {table} ON " + " AND ".join(f"{a} = {b}" for a, b in zip(held, keys))
                if kind in ("FULL OUTER", "RIGHT OUTER"):
                    held = [f"coalesce({a}, {b})" for a, b in zip(held, keys)]
                kept = kept or keep
            ts[k:end] = [_t(text + " ", t)]
            break
    return ts


def lateral_in_joins(ts: list[Token], c: Context) -> list[Token]:
    """a LATERAL VIEW [OUTER] f(x) t AS c1, c2 JOIN b ... -> a [LEFT] JOIN LATERAL f(x) t(c1, c2) JOIN b ..."""
    joins = {"JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL"}
    ts = list(ts)
    k = 0
    while k < len(ts):
        if ts[k].up == "LATERAL" and _is(ts, v := _next(ts, k), "VIEW"):
            f = _next(ts, v)
            outer = _is(ts, f, "OUTER")
            f = _next(ts, f) if outer else f
            if _is(ts, o := _next(ts, f), "("):
                z = closing(ts, o)
                name = _next(ts, z)
                end, cols = name, []
                if _is(ts, _next(ts, name), "AS"):
                    end = _next(ts, _next(ts, name))
                    cols.append(ts[end].text)
                    while _is(ts, _next(ts, end), ","):
                        end = _next(ts, _next(ts, end))
                        cols.append(ts[end].text)
                if _is(ts, _next(ts, end), *joins):
                    call = f"{render(ts[f : z + 1])} {ts[name].text}" + (f"({', '.join(cols)})" if cols else "")
                    ts[k : end + 1] = [_t(f"LEFT JOIN LATERAL {call} ON true" if outer else f"CROSS JOIN LATERAL {call}", ts[k])]
        k += 1
    return ts


def function_ctes(ts: list[Token], c: Context) -> list[Token]:
    """WITH f(@a INT) AS (query or expression): its calls become its text, with the arguments, cast, in place of the parameters."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        if not (ts[k].up == "WITH" and ts[k].kind == "word"):
            k += 1
            continue
        at, kept, made = _next(ts, k), [], {}
        while at < len(ts) and ts[at].kind in ("word", "quoted"):
            first, name = at, ts[at].text.strip("`").lower()
            o, params = _next(ts, at), None
            if _is(ts, o, "("):
                z = closing(ts, o)
                inner = significant(ts[o + 1 : z])
                if inner and inner[0].text[0] == "@":
                    params = [(p[0].text, " ".join(t.text for t in p[1:])) for p in map(significant, _split(ts[o + 1 : z]))]
                o = _next(ts, z)
            while params is not None and o < len(ts) and not _is(ts, o, "AS"):  # RETURNS @r type
                o = _next(ts, o)
            if not _is(ts, o, "AS") or not _is(ts, b := _next(ts, o), "("):
                break
            z = closing(ts, b)
            if params is None:
                kept.append(render(ts[first : z + 1]))
            else:
                made[name] = params, ts[b + 1 : z]
            at = _next(ts, z)
            if not _is(ts, at, ","):
                break
            at = _next(ts, at)
        if made:
            ts[k:at] = [_t(f"WITH {', '.join(kept)} " if kept else "", ts[k])]
            ts = tokenize(_calls(tokenize(render(ts)), made))
        k += 1
    return ts


def _calls(ts: list[Token], made: dict[str, tuple[list[tuple[str, str]], list[Token]]]) -> str:
    out, k = [], 0
    while k < len(ts):
        name = ts[k].text.strip("`").lower()
        if ts[k].kind in ("word", "quoted") and name in made and _is(ts, o := _next(ts, k), "("):
            z = closing(ts, o)
            args = [_calls(a, made).strip() for a in _split(ts[o + 1 : z]) if significant(a)]
            params, body = made[name]
            if len(args) != len(params):
                raise ValueError(f"{name} takes {len(params)} arguments, not {len(args)}")
            value = {p.lower(): f"CAST({a} AS {kind})" if kind else f"({a})" for (p, kind), a in zip(params, args)}
            text = "(" + _calls(tokenize("".join(value.get(t.text.lower(), t.text) if t.kind == "word" else t.text for t in body)), {n: m for n, m in made.items() if n != name}) + ")"
            p = _prev(ts, k)
            after = _next(ts, z)
            if _is(ts, p, "FROM", "JOIN") and not (after < len(ts) and (_is(ts, after, "AS") or ts[after].kind in ("word", "quoted") and ts[after].up not in _AFTER_SOURCE)):
                text += f" {name}"
            out.append(text)
            k = z
        else:
            out.append(ts[k].text)
        k += 1
    return "".join(out)


#: Words that come after a table without an alias.
_AFTER_SOURCE = frozenset("ON USING WHERE GROUP HAVING ORDER SORT CLUSTER DISTRIBUTE ZORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS JOIN LEFT RIGHT FULL INNER CROSS NATURAL LATERAL WINDOW TABLESAMPLE SEMI ANTI SELECT INSERT".split())


def scan_clauses(ts: list[Token], c: Context) -> list[Token]:
    """t PARTITION (k = v, j) in a FROM -> the rows of those partitions; t ('k' = 'v') -> t read with these options."""
    ts = list(ts)
    k = 0
    while k < len(ts):
        p = _prev(ts, k)
        if ts[k].kind in ("word", "quoted") and (_is(ts, p, "FROM", "JOIN") or _is(ts, p, ",") and _in_from(ts, p)) and not _is(ts, _prev(ts, p), "DELETE"):
            end = k
            while _is(ts, _next(ts, end), "."):
                end = _next(ts, _next(ts, end))
            name, last, n = render(ts[k : end + 1]), ts[end].text, _next(ts, end)
            text, stop = name, end
            if _is(ts, n, "(") and (inner := significant(ts[n + 1 : closing(ts, n)])) and inner[0].kind == "string" and len(inner) > 2 and inner[1].text == "=":
                options = {x[0].text[1:-1]: x[2].text.strip("'\"") for x in map(significant, _split(ts[n + 1 : closing(ts, n)]))}
                text, stop = c.scan(name, options), closing(ts, n)
                n = _next(ts, stop)
            if _is(ts, n, "PARTITION") and _is(ts, o := _next(ts, n), "("):
                stop = closing(ts, o)
                given = [render(x).strip() for x in _split(ts[o + 1 : stop]) if any(t.text == "=" for t in x)]
                text = f"(SELECT * FROM {text}{' WHERE ' + ' AND '.join(given) if given else ''})"
            if stop > end:
                after = _next(ts, stop)
                named = after < len(ts) and (_is(ts, after, "AS") or ts[after].kind in ("word", "quoted") and ts[after].up not in _AFTER_SOURCE)
                ts[k : stop + 1] = [_t(text if named else f"{text} {last}", ts[k])]
        k += 1
    return ts


def _in_from(ts: list[Token], k: int) -> bool:
    """Whether a comma stands between sources: the last clause before it at its depth is FROM."""
    depth = 0
    while k >= 0:
        if ts[k].kind == "op":
            depth += (ts[k].text == ")") - (ts[k].text == "(")
        if depth < 0:
            return False
        if not depth and ts[k].kind == "word" and ts[k].up in ("SELECT", "FROM", "WHERE", "BY", "HAVING", "ON", "VALUES", "SET", "WINDOW", "WITH"):
            return ts[k].up == "FROM"
        k -= 1
    return False


RULES = [
    full_width, parameters, charset_strings, function_ctes, variables, hints, zorder, unique_join, lateral_in_joins, scan_clauses, bucket_sample, limit_pair, several_on, lambda_functions, interval_expressions,
    qualified_functions, method_calls, filter_over, extended_windows, frames, typed_words, renamed_functions, xor_precedence,
]


def rewrite(text: str, context: Context | None = None, parse_only: bool = False) -> str:
    """Spark SQL for a statement of the dialect. Rules see each other's results, as tokens.

    ``parse_only`` keeps function names as written: enough for a parser, which takes any name.
    """
    c = context or Context()
    for rule in RULES:
        if not (parse_only and rule is renamed_functions):
            text = render(rule(tokenize(text), c))
    return text
