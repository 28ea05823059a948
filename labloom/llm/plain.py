"""One plain form for text that reads the same but differs in its characters.

DuckDB runs inside Arrow partitions: one embedded SQL expression maps compatibility forms (full-width letters, ligatures),
drops invisible characters, turns every other space into U+0020, composes accents with nfc_normalize, and gives Greek and
Cyrillic letters drawn like a Latin one their Latin form in words that have Latin letters or consist of such letters only.
Composed accents, words truly in other scripts, small alpha, beta and gamma, dashes and signs such as the greater-or-equal
sign are plain. A field is out of form if its plain form differs from it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Letters drawn like a Latin one, and that letter.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
}


def _tables() -> tuple[str, str, dict[str, str]]:
    """Invisible characters, spaces, and compatibility forms with what they stand for, by rule from the Unicode data."""
    invisible, spaces, compat = [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            spaces.append(c)
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            invisible.append(c)
        elif unicodedata.decomposition(c).startswith("<"):
            compat[c] = "".join(" " if unicodedata.category(x) == "Zs" else x for x in unicodedata.normalize("NFKC", c))
    return "".join(invisible), "".join(spaces), compat


def _class(chars: str) -> str:
    """A regular-expression class of the characters, as ranges."""
    cps, out, i = sorted(map(ord, chars)), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(rf"\x{{{cps[i]:x}}}" + (rf"-\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain_sql(column: str) -> list[str]:
    """SELECT lists, to be applied one after the other, that bring ``column`` into plain form; each replaces it."""
    invisible, spaces, compat = _tables()
    wide = {c: t for c, t in compat.items() if "！" <= c <= "～"}
    rest = {c: t for c, t in compat.items() if c not in wide}
    look, words = "".join(LOOKALIKES), r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]"
    entries = ", ".join(f"{_quoted(c)}: {_quoted(t)}" for c, t in rest.items())
    when = "CASE WHEN regexp_matches({c}, {p}) THEN {e} ELSE {c} END"
    say = lambda pattern, expression: when.format(c=column, p=_quoted(pattern), e=expression)
    each = f"CASE WHEN regexp_matches(w, {_quoted(_class(look))}) AND (regexp_matches(w, '\\p{{Latin}}') OR NOT regexp_matches(w, {_quoted('[^' + _class(look)[1:-1] + r'\p{M}]')})) THEN translate(w, {_quoted(look)}, {_quoted(''.join(LOOKALIKES.values()))}) ELSE w END"
    return [
        say(_class("".join(wide)), f"translate({column}, {_quoted(''.join(wide))}, {_quoted(''.join(wide.values()))})"),
        say(_class("".join(rest)), f"array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda c: coalesce(MAP {{{entries}}}[c], c)), '')"),
        say(_class(invisible), f"regexp_replace({column}, {_quoted(_class(invisible))}, '', 'g')"),
        say(_class(spaces), f"regexp_replace({column}, {_quoted(_class(spaces))}, ' ', 'g')"),
        say(_class(look), f"array_to_string(list_transform(regexp_extract_all({column}, {_quoted(f'{words}+|[^' + words[1:] + '+')}), lambda w: {each}), '')"),
        say(r"[^\x00-\x7f]", f"nfc_normalize({column})"),
    ]


def plain_query() -> str:
    """The embedded SQL: plain forms of the strings s of a table given(i, s) that have characters beyond ASCII."""
    query = "SELECT i, s FROM given WHERE regexp_matches(s, '[^\\x00-\\x7f]')"
    for step in plain_sql("s"):
        query = f"SELECT i, {step} AS s FROM ({query})"
    return query


def to_plain(con, columns: list[pa.Array], query: str) -> list[pa.Array]:
    """The plain form of every string of the columns, by plain_query(), which is built once on the driver.

    One query serves all columns, and each different string beyond ASCII goes through it once; ASCII is plain as it is.
    """
    import numpy as np
    import pyarrow.compute as pc

    odd = [pc.fill_null(pc.invert(pc.string_is_ascii(c)), False) for c in columns]
    parts = [c.filter(m).cast(pa.large_string()) for c, m in zip(columns, odd, strict=True)]
    coded = pa.concat_arrays(parts).dictionary_encode()
    if not len(coded):
        return columns
    given = coded.dictionary
    con.register("given", pa.table({"i": pa.array(range(len(given)), pa.int64()), "s": given}))
    found = con.sql(query).to_arrow_table()
    con.unregister("given")
    place = np.arange(len(given))
    place[found.column("i").to_numpy()] = len(given) + np.arange(found.num_rows)
    known = pa.concat_arrays([given, *found.column("s").cast(pa.large_string()).chunks]).take(pa.array(place)).take(coded.indices)
    out, at = [], 0
    for c, m, part in zip(columns, odd, parts, strict=True):
        out.append(pc.replace_with_mask(c, m, known.slice(at, len(part)).cast(c.type)) if len(part) else c)
        at += len(part)
    return out


def connect():
    """An embedded DuckDB of one thread and little memory, as it runs beside others in an executor."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '256MB'")
    con.execute("SET temp_directory = ''")  # nothing is ever spilled beside the executor
    con.execute("SET preserve_insertion_order = false")
    return con


def _plain_batches(fields: int):
    """For mapInArrow: id, then string columns; they come out plain, with a list of the names of those that weren't."""
    query = plain_query()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        con = connect()
        for batch in batches:
            names = batch.schema.names
            plain = to_plain(con, batch.columns[1:], query)
            changed = [pc.fill_null(pc.not_equal(plain[i], batch.column(i + 1)), False).to_pylist() for i in range(fields)]
            listed = pa.array([[names[i + 1] for i in range(fields) if row[i]] for row in zip(*changed, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *plain, listed], [*names, "_changed"])
        con.close()

    return run


def plain_fields(rows: DataFrame, fields: list[str], *, id_col: str = "id") -> DataFrame:
    """One row for each row: its id, the fields in plain form, and ``changed_fields`` array<string>.

    Null stays null, empty stays empty; repeated rows give repeated rows; other columns are ignored. No shuffle.
    """
    names = [f"f{i}" for i in range(len(fields))]
    chosen = rows.select(F.col(id_col).alias("_id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)])
    id_type = chosen.schema["_id"].dataType.simpleString()
    done = chosen.mapInArrow(_plain_batches(len(fields)), f"_id {id_type}, {', '.join(f'{n} string' for n in names)}, _changed array<string>")
    real = F.create_map(*[F.lit(x) for pair in zip(names, fields, strict=True) for x in pair])
    return done.select(F.col("_id").alias(id_col), *[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)], F.transform("_changed", lambda c: real[c]).alias("changed_fields"))


def changed_fields(rows: DataFrame, fields: list[str], *, id_col: str = "id") -> DataFrame:
    """(id, field_name) of every field that is not in plain form."""
    return plain_fields(rows, fields, id_col=id_col).select(id_col, F.explode("changed_fields").alias("field_name"))
