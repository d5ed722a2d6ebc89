"""Table extraction from landed HTML inside the JVM, by a scan over its table tags.

A page is cut in front of every tag that belongs to a table. One fold over the kinds of
these tags keeps the depth of tables and writes one letter per tag: whether it starts a
block, a row or a cell, or stands in a table within a cell, which leaves its text there.
Any number of inner tables, side by side or nested, takes the same single pass. Rows
and cells need no closing tags: each goes up to the next tag that ends it. A row with
an inner table that is never closed is marked. Named entities of the table below and
numeric ones are decoded.
"""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.lambdas import literal, map_value
from labelloom.functions.text import strip_blanks

#: Signs between blocks, rows and cells, and at the end of an open row: noncharacters, which no page may hold.
BLOCK, ROW, CELL, OPEN = "\ufdd0\ufdd1\ufdd2\ufdd3"
_TABLE_TAG = r"/?(?:table|t[dhr]|tbody|thead|tfoot)\b"
#: Named entities: the published Latin-1 names, and a few signs besides.
_MORE = ("quot", "lt", "gt", "apos", "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "bdquo", "hellip", "bull", "euro", "oelig", "OElig", "trade")
_NAMES = {n: c for n in html.entities.name2codepoint if 160 <= (c := html.entities.name2codepoint[n]) <= 255}
_NAMES |= {n: ord(html.unescape(f"&{n};")) for n in _MORE}


def _kinds(opening: str) -> str:
    """One letter for the tag at the beginning of every piece of ``w``; block openings are told from other tags."""
    block = f"contains(g, 'class') and g rlike {literal('^(?is)<' + opening)}"
    # Besides block openings a piece begins with a table tag; the first one may begin with text.
    return f"""transform(transform(w, g -> named_struct('tag', lower(left(g, 5)), 'block', {block}, 'own', g rlike '^(?i)<table\\\\b')), t -> case
        when t.block then if(t.own, 'b', 'c')
        when startswith(t.tag, '<td') then 'd' when startswith(t.tag, '</td') then 'f' when startswith(t.tag, '<tr') then 'r'
        when t.tag in ('<thea', '</the') then 'e' when startswith(t.tag, '<th') then 'h' when startswith(t.tag, '</th') then 'f'
        when t.own then 't' when t.tag = '</tab' then 'z' when startswith(t.tag, '<') then 'e' else 'o' end)"""


#: Depth of tables (-1 outside a block), whether a row and a cell are open, and the letters so far.
_STATE = "named_struct('depth', -1, 'row', false, 'cell', false, 'marks', '')"
#: B, R, H and D start a block, a row and the two kinds of cells; i and n are text of an open cell, n on a new line.
_STEP = """named_struct(
    'depth', case when s.depth < 0 then case k when 'b' then 1 when 'c' then 0 else -1 end
        when k in ('t', 'b') then greatest(s.depth, 0) + 1
        when k = 'z' then if(s.depth > 1, s.depth - 1, -1) else s.depth end,
    'row', case when s.depth > 1 then s.row when s.depth < 0 or k in ('e', 'z') then false else s.row or k = 'r' end,
    'cell', case when s.depth > 1 then s.cell when s.depth < 0 then false when k in ('h', 'd') then s.row
        else s.cell and k in ('t', 'b', 'c') end,
    'marks', concat(s.marks, case
        when s.depth < 0 then if(k in ('b', 'c'), 'B', '.')
        when s.depth > 1 then case when not s.cell then '.' when k in ('t', 'b', 'c', 'z') then 'i' else 'n' end
        when k = 'r' then 'R'
        when k in ('h', 'd') then if(s.row, upper(k), '.')
        when k in ('t', 'b', 'c') and s.cell then 'i' else '.' end))"""


def blocks(page: Column, css_class: str) -> Column:
    """The elements of one class in document order, each an array of its rows up to its closing table tag or the end.

    A row is a struct: ``closed``, false where a table in its last cell never ends, and
    ``cells``, each with a letter in front, h or d, for header and data cells.
    """
    opening = rf"\w+[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{css_class}(?:\s[^\"']*)?[\"'][^>]*>"
    page = F.translate(page, BLOCK + ROW + CELL + OPEN, "")
    pieces = F.split(page, rf"(?is)(?=<(?:{_TABLE_TAG}|{opening}))", -1)
    body = "regexp_replace(g, '^<[^>]*>?', '')"
    text = f"""concat(array_join(zip_with(p.pieces, split(p.found.marks, ''), (g, k) -> case k
        when 'B' then '{BLOCK}' when 'R' then '{ROW}' when 'H' then concat('{CELL}h', {body})
        when 'D' then concat('{CELL}d', {body}) when 'i' then {body} when 'n' then concat('<br>', {body})
        else '' end), ''), if(p.found.depth > 1, '{OPEN}', ''))"""
    scanned = f"""get(transform(array(named_struct('pieces', w, 'found', aggregate(
        {_kinds(opening)}, {_STATE}, (s, k) -> {_STEP}))), p -> {text}), 0)"""
    behind = "filter(split({}, '{}'), (x, i) -> i > 0)".format
    cells = behind(f"rtrim('{OPEN}', r)", CELL)
    rows = f"transform({behind('b', ROW)}, r -> struct(not endswith(r, '{OPEN}') as closed, {cells} as cells))"
    return map_value(map_value(pieces, scanned), f"transform({behind('w', BLOCK)}, b -> {rows})")


def _cells(row: Column, kind: str) -> Column:
    """Texts of the cells of a kind, in two steps: the second one names its argument more than once."""
    bare = F.transform(F.filter(row["cells"], lambda c: c.startswith(kind)), lambda c: _without_tags(F.substr(c, F.lit(2))))
    return F.transform(bare, lambda t: strip_blanks(decode_entities(t)))


def header_cells(row: Column) -> Column:
    return _cells(row, "h")


def data_cells(row: Column) -> Column:
    return _cells(row, "d")


def _decoded(part: Column) -> Column:
    """The character of an entity; what is none stays as it is."""
    body = F.substr(part, F.lit(2), F.length(part) - 2)
    hexadecimal = F.conv(F.substr(body, F.lit(3)), 16, 10).cast("int")
    code = F.when(body.rlike("^#[xX]"), hexadecimal).otherwise(F.substr(body, F.lit(2)).cast("int"))
    # A code point as UTF-32 is four bytes.
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    names = F.create_map(*[F.lit(x) for n, c in _NAMES.items() for x in (n, chr(c) if c != 160 else " ")])
    number = F.when(valid, F.when(code == 160, F.lit(" ")).otherwise(letter)).otherwise(part)
    return F.when(~part.rlike("^&.+;$"), part).when(body.startswith("#"), number).otherwise(
        F.coalesce(F.try_element_at(names, body), part)
    )


def decode_entities(text: Column) -> Column:
    """Decode every entity once; text without an ampersand is left alone."""
    entity = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){entity}|[^&]+|&"), F.lit(0))
    found = F.array_join(F.transform(parts, lambda p: F.when(p == "&amp;", F.lit("&")).otherwise(_decoded(p))), "")
    return F.when(text.contains("&"), found).otherwise(text)


def _without_tags(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cell, r"(?i)<br\s*/?>", "\n"), r"(?s)<.*?>", "")


def cell_text(cell: Column) -> Column:
    """Visible text: line breaks kept, tags removed, entities decoded, trimmed."""
    return strip_blanks(decode_entities(_without_tags(cell)))
