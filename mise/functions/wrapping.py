"""Line wrapping as one expression: the rules of Python's ``textwrap`` on the JVM.

A text is split into chunks (runs of blanks, words, parts of hyphenated words) by one
regular expression; an in-row fold puts chunks on lines.  Its state is the open
line, so a step costs the same however long the text is; finished lines are
gathered in blocks of chunks, so their text is copied block by block and not once for each line.

The rules: tabs go to the next multiple of eight, other line and page breaks are blanks; a line
takes chunks while they fit; a blank chunk that ends a line, or would begin any line but the
first, goes; a chunk longer than a whole line is cut to fill the line, after its last hyphen
there if something else stands before it.
"""

from __future__ import annotations

from .text import WS_BEYOND, WS_CLASS, WS_LATIN, sql_str

# --- fixed values -----------------------------------------------------------
# Characters after which, and letters between which, a word may be divided.
PUNCTUATED = r"""[\p{L}\p{N}_!"'&.,?]"""
LETTER = r"[\p{L}\p{Nl}\p{No}_]"
WORD = r"[\p{L}\p{N}_]"
CHUNK_RX = (rf" +|(?<={PUNCTUATED})-{{2,}}(?={WORD})"
            rf"|[^ ]+?(?:-(?:(?<={LETTER}{{2}}-)|(?<={LETTER}-{PUNCTUATED}-))(?={LETTER}-?{LETTER})"
            rf"|(?= |\z)|(?<={PUNCTUATED})(?=-{{2,}}{WORD}))")
BLANK_RX = f"^{WS_CLASS}*$"
ENDS_BLANK_RX = f"{WS_CLASS}$"
TAB_STOP = 8
WIDTH = 75
# Texts with any of these take the fold.
UNEVEN_RX = rf"[\-{WS_LATIN.replace(chr(92) + 'x{20}', '')}{WS_BEYOND}]|  |^ | $"
# Printable characters below U+0100 but the hyphen, each spelled out: one table lookup in Java.
EVEN_CHARS = "".join(rf"\x{{{c:x}}}" for c in (*range(0x21, 0x7f), *range(0xa1, 0x100)) if chr(c) != "-")
# ---------------------------------------------------------------------------
BLOCK = 1024
# Lengths of prefixes for which texts of plain words have an expression of their own.
PLAIN_PREFIXES = (0, 2, 3, 4, 5)


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def spaced_sql(x: str) -> str:
    """Tabs expanded, other ASCII white space as blanks."""
    cells = (f"array_join(transform(split({x}, '[\\n\\r]'), tl -> "
             + _let("tc", "split(tl, '\\t')", "array_join(transform(tc, (tq, tk) -> CASE WHEN tk < size(tc) - 1 "
                    f"THEN concat(tq, repeat(' ', {TAB_STOP} - length(tq) % {TAB_STOP})) ELSE tq END), '')") + "), ' ')")
    spaced = _let("ts", f"CASE WHEN instr({x}, '\\t') > 0 THEN {cells} ELSE {x} END",
                  f"CASE WHEN ts RLIKE '[\\n\\r\\u000b\\u000c]' THEN translate(ts, '\\n\\r\\u000b\\u000c', '    ') ELSE ts END")
    return spaced


def _blank(x: str) -> str:
    return f"({x} RLIKE {sql_str(BLANK_RX)})"


def _state(**fields: str) -> str:
    names = ("out", "line", "tail", "begun", "fresh", "rest")
    return "named_struct(" + ", ".join(f"'{n}', {fields[n]}" for n in names) + ")"


def _emitted(out: str, line: str, tail: str, begun: str) -> tuple[str, str]:
    """(out, begun) after a line is closed; ``tail`` is the length of its last chunk if that is blank, else -1."""
    text = f"CASE WHEN {tail} >= 0 THEN left({line}, length({line}) - {tail}) ELSE {line} END"
    more = _let("et", text, f"CASE WHEN et = '' THEN {out} ELSE concat({out}, CASE WHEN {begun} THEN v.pad ELSE v.prefix END, et, '\\n') END")
    return more, f"({begun} OR ({text}) <> '')"


def _step() -> str:
    """One chunk ``c`` (null: what is left of a long one) put on the lines of state ``s``; ``v`` holds width, prefix and pad."""
    piece = _let("ph", "left(r, v.width - length(s.line))",
                 _let("pi", "length(ph) - instr(reverse(ph), '-')",
                      "CASE WHEN instr(ph, '-') > 0 AND pi > 0 AND translate(left(ph, pi), '-', '') <> '' THEN left(ph, pi + 1) ELSE ph END"))
    closed_out, closed_begun = _emitted("s.out", "s.line", "s.tail", "s.begun")
    cut_out, cut_begun = _emitted("s.out", "concat(s.line, p)", "(CASE WHEN " + _blank("p") + " THEN length(p) ELSE -1 END)", "s.begun")
    dropped = _state(out="s.out", line="s.line", tail="s.tail", begun="s.begun", fresh="false", rest="''")
    put = _state(out="s.out", line="concat(s.line, r)", tail="CASE WHEN b THEN length(r) ELSE -1 END", begun="s.begun", fresh="false", rest="''")
    cut = _let("p", piece, _state(out=cut_out, line="''", tail="-1", begun=cut_begun, fresh="true", rest="substr(r, length(p) + 1)"))
    next_line = _let("nb", closed_begun, _state(out=closed_out, line="CASE WHEN nb AND b THEN '' ELSE r END",
                                                tail="CASE WHEN b AND NOT nb THEN length(r) ELSE -1 END", begun="nb", fresh="false", rest="''"))
    placed = (f"CASE WHEN s.fresh AND s.begun AND b THEN {dropped} WHEN length(s.line) + length(r) <= v.width THEN {put} "
              f"WHEN length(r) > v.width THEN {cut} ELSE {next_line} END")
    return _let("r", "coalesce(c, s.rest)", f"CASE WHEN r = '' THEN s ELSE {_let('b', _blank('r'), placed)} END")


def wrapped_sql(x: str, prefix: str, width: int) -> str:
    """Lines of ``x``, each with a line feed: the first after ``prefix``, the others after as many blanks."""
    start = _state(out="''", line="''", tail="-1", begun="false", fresh="true", rest="''")
    chunks = (f"flatten(transform(regexp_extract_all(v.t, {sql_str(CHUNK_RX)}, 0), k -> CASE WHEN length(k) > v.width "
              "THEN concat(array(k), array_repeat(CAST(NULL AS STRING), CAST(2 * ceil(length(k) / v.width) + 3 AS INT))) ELSE array(k) END))")
    again = _state(out="''", line="a.s.line", tail="a.s.tail", begun="a.s.begun", fresh="a.s.fresh", rest="a.s.rest")
    block = f"aggregate(slice(q, i * {BLOCK} + 1, {BLOCK}), {again}, (s, c) -> {_step()})"
    gathered = _let("z", block, "named_struct('done', concat(a.done, z.out), 's', z)")
    folded = (f"aggregate(sequence(0, CAST((size(q) - 1) DIV {BLOCK} AS INT)), named_struct('done', '', 's', {start}), "
              f"(a, i) -> {gathered})")
    last, _ = _emitted("f.done", "f.s.line", "f.s.tail", "f.s.begun")
    long = _let("q", chunks, _let("f", folded, last))
    # All of it fits on the first line, and no blank ends it.
    short = f"length(v.t) <= v.width AND NOT v.t RLIKE {sql_str(ENDS_BLANK_RX)}"
    values = (f"named_struct('t', {spaced_sql(x)}, 'prefix', {prefix}, 'pad', repeat(' ', length({prefix})), 'width', {width} - length({prefix}))")
    # Words between single blanks, none divided or too long: the fold comes to what this expression takes line by line.
    plain = f"NOT v.t RLIKE {sql_str(UNEVEN_RX)} AND NOT v.t RLIKE {sql_str(f'(?:^| )[^ ]{{{width - PLAIN_PREFIXES[-1] + 1}}}')}"
    by_width = " ".join(f"WHEN {p} THEN regexp_replace(v.t, {sql_str(f'(.{{1,{width - p}}})(?: |$)')}, concat('$1\\n', v.pad))" for p in PLAIN_PREFIXES)
    even = _let("e", f"concat(v.prefix, CASE length(v.prefix) {by_width} END)", "left(e, length(e) - length(v.pad))")
    body = (f"CASE WHEN v.t = '' THEN '' WHEN {short} THEN concat(v.prefix, v.t, '\\n') "
            f"WHEN length(v.prefix) IN ({', '.join(map(str, PLAIN_PREFIXES))}) AND {plain} THEN {even} ELSE {long} END")
    # The usual text, looked at first and in one run: such words, short enough, between single blanks. One blank may
    # lead, where it leaves room for the first word.
    longest = width - PLAIN_PREFIXES[-1]
    word = f"[{EVEN_CHARS}]{{1,{longest}}}+"
    usual = f"{x} RLIKE {sql_str(f'^ ?{word}(?: {word})*+' + chr(92) + 'z')} AND (length({prefix}) < {PLAIN_PREFIXES[-1]} OR NOT startswith({x}, ' '))"
    filled = " ".join(f"WHEN {p} THEN regexp_replace({x}, {sql_str(f'(.{{1,{width - p}}})(?: |$)')}, {sql_str('$1' + chr(10) + ' ' * p)})" for p in PLAIN_PREFIXES)
    return (f"CASE WHEN length({prefix}) IN ({', '.join(map(str, PLAIN_PREFIXES))}) AND {usual} "
            f"THEN rtrim(concat({prefix}, CASE length({prefix}) {filled} END)) ELSE {_let('v', values, body)} END")


def wrapped_groups_sql(groups: str, mode: str, bullet: str, blank_after: str, width: int = WIDTH) -> str:
    """All items of a list of lists: ``numbered`` from 1 in each list, after a ``bullet``, or ``plain``."""
    prefix = f"CASE {mode} WHEN 'numbered' THEN concat(CAST(n + 1 AS STRING), '. ') WHEN 'bullet' THEN concat({bullet}, ' ') ELSE '' END"
    item = _let("pf", prefix, f"concat({wrapped_sql('y', 'pf', width)}, CASE WHEN {blank_after} THEN '\\n' ELSE '' END)")
    return (f"array_join(transform({groups}, g -> array_join(transform(coalesce(g, CAST(array() AS ARRAY<STRING>)), "
            f"(x, n) -> {_let('y', "coalesce(x, '')", item)}), '')), '')")
