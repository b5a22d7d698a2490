"""Building blocks of the DuckDB oracle SQL: the same rules written as DuckDB list folds."""

from __future__ import annotations

from ragtables.functions.chunkers import RECURSIVE_SEPARATORS
from ragtables.functions.text import WHITESPACE

WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
# RE2 character class body of the same set
WS_RE2 = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NL2 = "(chr(10) || chr(10))"
EMPTY = "[]::VARCHAR[]"


def lit(s: str) -> str:
    """A DuckDB expression for the string ``s`` (built from chr() so no escaping is involved)."""
    if s == "":
        return "''"
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return strip(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


def nonblank(arr: str) -> str:
    return f"list_filter(list_transform({arr}, lambda x: {strip('x')}), lambda x: length(x) > 0)"


def finish(st: str) -> str:
    return f"(CASE WHEN length({st}.cur) > 0 THEN list_append({st}.out, {st}.cur) ELSE {st}.out END)"


def windows(p: str, size: int, overlap: int) -> str:
    step = size - overlap
    last = f"greatest(0, ceil((length({p}) - {size}) / {step})::BIGINT)"
    return (
        f"list_filter(list_transform(range(0, {last} + 1), lambda i: {strip(f'substring({p}, i * {step} + 1, {size})')}), "
        f"lambda s: length(s) > 0)"
    )


def fixed(t: str, size: int, overlap: int) -> str:
    """C2 over an already cleaned text expression."""
    paras = nonblank(f"string_split({t}, {NL2})")
    step = (
        "lambda acc, p: CASE "
        f"WHEN length(p) <= {size} AND length(acc.cur) = 0 THEN {{'out': acc.out, 'cur': p}} "
        f"WHEN length(p) <= {size} AND length(acc.cur) + 2 + length(p) <= {size} THEN {{'out': acc.out, 'cur': acc.cur || {NL2} || p}} "
        f"WHEN length(p) <= {size} THEN {{'out': list_append(acc.out, acc.cur), 'cur': p}} "
        f"ELSE {{'out': list_concat({finish('acc')}, {windows('p', size, overlap)}), 'cur': ''}} END"
    )
    st = f"list_reduce({paras}, {step}, {{'out': {EMPTY}, 'cur': ''}})"
    return finish(st)


def pack(segs: str, sep: str, size: int) -> str:
    s = lit(sep)
    step = (
        "lambda acc, x: CASE "
        "WHEN length(acc.cur) = 0 THEN {'out': acc.out, 'cur': x} "
        f"WHEN length(acc.cur) + {len(sep)} + length(x) <= {size} THEN {{'out': acc.out, 'cur': acc.cur || {s} || x}} "
        "ELSE {'out': list_append(acc.out, acc.cur), 'cur': x} END"
    )
    return finish(f"list_reduce({nonblank(segs)}, {step}, {{'out': {EMPTY}, 'cur': ''}})")


def overlap(chunks: str, o: int) -> str:
    if o <= 0:
        return chunks
    return f"list_transform({chunks}, lambda c, i: CASE WHEN i = 1 THEN c ELSE right({chunks}[i - 1], {o}) || c END)"


def recursive_ctes(src: str, key: str, col: str, size: int, ov: int, prefix: str = "lv") -> tuple[list[str], str]:
    """CTEs for C4 over ``src(key, col)`` where ``col`` is a list of sections (list of list of pieces).

    Returns (ctes, last_cte); the last CTE has ``key`` and ``chunks``.
    """
    ctes = []
    prev = src
    for i, sep in enumerate(RECURSIVE_SEPARATORS[:-1]):
        name = f"{prefix}{i}"
        lv = f"lambda p: CASE WHEN length(p) <= {size} THEN [p] ELSE {pack(f'string_split(p, {lit(sep)})', sep, size)} END"
        ctes.append(f"{name} AS (SELECT {key}, list_transform({col}, lambda ps: flatten(list_transform(ps, {lv}))) AS {col} FROM {prev})")
        prev = name
    name = f"{prefix}w"
    lv = f"lambda p: CASE WHEN length(p) <= {size} THEN [p] ELSE {windows('p', size, ov)} END"
    ctes.append(f"{name} AS (SELECT {key}, list_transform({col}, lambda ps: flatten(list_transform(ps, {lv}))) AS {col} FROM {prev})")
    prev = name
    name = f"{prefix}o"
    ctes.append(f"{name} AS (SELECT {key}, flatten(list_transform({col}, lambda ps: {overlap('ps', ov)})) AS chunks FROM {prev})")
    return ctes, name


def heading_marked(t: str) -> str:
    pat = (
        "(?m)^("
        f"#{{1,6}}[{WS_RE2}]"
        r"|记录 \p{Nd}"
        "|第[0-9一二三四五六七八九十百千]+[章节部分条]"
        f"|\\p{{Nd}}+\\.[{WS_RE2}]"
        "|[一二三四五六七八九十]+、"
        ")"
    )
    return f"regexp_replace({t}, '{pat}', chr(1) || '\\1', 'g')"


def sections(t: str) -> str:
    """C7 over a cleaned text expression."""
    parts = f"string_split({heading_marked(t)}, chr(1))"
    paras = nonblank(f"string_split({t}, {NL2})")
    cuts = f"(len({parts}) - 1 - CASE WHEN starts_with({heading_marked(t)}, chr(1)) THEN 1 ELSE 0 END)"
    whole = f"CASE WHEN length({strip(t)}) > 0 THEN [{strip(t)}] ELSE {EMPTY} END"
    return f"(CASE WHEN {cuts} > 0 THEN {nonblank(parts)} WHEN len({paras}) > 1 THEN {paras} ELSE {whole} END)"


def tokens(x: str) -> str:
    return f"list_concat(regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+'), regexp_extract_all(lower({x}), '[一-鿿]'))"


def hash_embed(x: str, dim: int = 64) -> str:
    """Counts of md5 buckets of the tokens, L2-normalised, as FLOAT[]."""
    buckets = f"list_transform({tokens(x)}, lambda t: (('0x' || substr(md5(t), 1, 7))::BIGINT % {dim})::INTEGER)"
    counts = f"list_transform(range(0, {dim}), lambda j: len(list_filter({buckets}, lambda b: b = j))::DOUBLE)"
    return f"l2norm({counts})"


def explode_list(key: str, lst: str, src: str, idx: str = "chunk_index", val: str = "content") -> str:
    return f"SELECT {key}, unnest(range(len({lst})))::INTEGER AS {idx}, unnest({lst}) AS {val} FROM {src}"
