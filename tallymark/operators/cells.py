"""Tables of documents to label-value pairs, heads, items and totals, and what these and texts say together, a whole Arrow batch at once.

All cells of a batch lie in one array, with the places where rows, tables and documents start; each step is one pass of
``pyarrow.compute`` or numpy over them. What a step says of a row or a table follows from counts and first places.
Only numbers and labels in unusual forms, and texts with fixed-width lists, are looked at one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schema
from tallymark.functions import labels, text

#: White space as ``text.WS`` has it.
SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Fields of items, those that tell a head from others, and words that mark rows of totals.
ITEMS = ("description", "lot", "cartons", "net_kg", "gross_kg", "unit_price", "units", "amount")
ITEM_FIELDS = ("description", "cartons", "net_kg", "gross_kg", "unit_price", "units", "amount")
TOTAL_WORDS, TOTAL_ARABIC = ("total", "totale", "montant"), ("المجموع", "الإجمالي", "اجمالي")
SUMS = {"cartons": "cartons", "net_kg": "net_kg", "gross_kg": "gross_kg", "amount": "value"}
WHOLE = ("cartons", "units")
#: What tables say, as columns.
READ = {
    "_pairs": "array<struct<f:string,v:string,l:string>>", "_heads": "array<struct<v:string,f:string>>", "_items": f"array<{schema.ITEM}>",
    "_totals": "struct<cartons:bigint,net_kg:double,gross_kg:double,value:double>",
}
#: What tables and texts say together, as columns.
MERGED = {
    "_labels": "map<string,string>", "line_items": f"array<{schema.ITEM}>", "_totals": READ["_totals"], "_fixed_totals": "struct<cartons:bigint,net_kg:double,gross_kg:double>",
}
# Words that mark header lines and columns of fixed-width lists.
HEADER_WORDS = ("description", "descrizione", "net", "gross", "peso", "cartons", "colli", "ctns", "packages", "pkgs", "الوصف", "الوزن", "الصناديق", "كراتين")
COLUMN_WORDS = {
    "lot": ("lot", "لوط", "الدفعة", "numéro de lot", "n° de lot"),
    "description": ("description", "descrizione", "الوصف", "désignation"),
    "cartons": ("cartons", "colli", "no. of pkgs", "no. of packages", "ctns", "pkgs", "nombre de cartons", "nb de cartons", "colis", "الصناديق", "كراتين", "عدد الصناديق", "طرود"),
    "net_kg": ("peso neto kg", "peso netto kg", "n.w. (kgs)", "net wt", "net weight", "peso neto", "peso netto", "n.w.", "net", "poids net", "poids net kg", "p. net", "الوزن الصافي", "وزن صافي"),
    "gross_kg": ("peso bruto kg", "peso lordo kg", "gross wt", "gross weight", "peso bruto", "peso lordo", "g.w.", "gross", "poids brut", "poids brut kg", "p. brut", "الوزن الإجمالي", "الوزن الخام", "وزن إجمالي"),
}
DATA_LINE = "[A-Za-z][0-9]{4}[A-Za-z]"
_DATA = re.compile(DATA_LINE)
#: Documents that are read at once.
AT_ONCE = 4096
_DIGITS = str.maketrans(text.ARABIC_DIGITS, text.DIGITS)


def normal(label: str) -> str:
    """``labels.normal`` of one string."""
    return re.sub(rf"[{SPACE}:]+$", "", re.sub(f"[{SPACE}]+", " ", label.lower().strip(SPACE)))


def _unusual(v: str) -> float | None:
    """``text.number`` of one string that has none of the common forms."""
    s = re.sub("[€$£¥]", "", v.strip(SPACE).translate(_DIGITS))
    s = re.sub(rf"^[a-z]{{3}}[{SPACE}]*", "", s, flags=re.IGNORECASE).strip(SPACE)
    s = re.sub(rf"[{SPACE}]+[A-Za-z/]+$", "", s).strip(SPACE).replace(" ", "")
    if re.fullmatch(r"[0-9.]+,[0-9]{1,2}", s):
        plain = s.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"[0-9]{1,3}(\.[0-9]{3})+", s):
        plain = s.replace(".", "")
    elif s.count(",") == 1 and len(s.rpartition(",")[2]) <= 2:
        plain = s.replace(",", ".")
    else:
        plain = s.replace(",", "")
    return float(plain) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", plain) else None


def numbers(v: pa.Array) -> pa.Array:
    """``text.number`` of each string; null for null."""
    out, open_ = np.full(len(v), np.nan), v.is_valid().to_numpy(zero_copy_only=False)
    for pattern, drop in text.COMMON:
        at = np.flatnonzero(open_)
        if not len(at):
            break
        some = v.take(pa.array(at))
        fits = pc.match_substring_regex(some, pattern.replace("$", r"\z")).to_numpy(zero_copy_only=False)
        at, some = at[fits], some.filter(pa.array(fits))
        if drop == "unit":
            some = pc.replace_substring_regex(some, " .*", "")
        elif drop == ".":
            some = pc.replace_substring(pc.replace_substring(some, ".", ""), ",", ".")
        elif drop:
            some = pc.replace_substring(pc.replace_substring(some, ",", ""), " ", "")
        out[at] = some.cast(pa.float64()).to_numpy(zero_copy_only=False)
        open_[at] = False
    for i in np.flatnonzero(open_):
        found = _unusual(v[int(i)].as_py())
        out[i] = np.nan if found is None else found
    return pa.array(out, mask=np.isnan(out))


def whole(v: pa.Array) -> pa.Array:
    """Numbers cut toward zero; null for those that no long holds."""
    x = v.to_numpy(zero_copy_only=False).astype(float)
    bad = ~(np.abs(np.nan_to_num(x, nan=np.inf)) < 2.0**63)
    return pa.array(np.trunc(np.where(bad, 0, x)).astype(np.int64), mask=bad)


class Reader:
    def __init__(self, known: dict[str, str]):
        self.fields = sorted(set(known.values()) | set(ITEMS))
        self.no = {f: i for i, f in enumerate(self.fields)}
        self.known = {k: self.no[f] for k, f in known.items()}
        self.names, self.of_name = pa.array(list(self.known), pa.string()), np.array([*self.known.values(), -1], np.int32)
        self.digits = any(name[:1].isdigit() for name in known)

    def labels(self, v: pa.Array) -> np.ndarray:
        """The number of the field that each cell names, or -1."""
        found = self.of_name[pc.fill_null(pc.index_in(pc.utf8_lower(v), self.names), -1).to_numpy(zero_copy_only=False)]
        first_digit = pc.match_substring_regex(v, "^[0-9]").to_numpy(zero_copy_only=False) if not self.digits else np.zeros(len(v), bool)
        found[first_digit] = -1
        odd = np.flatnonzero((found < 0) & ~first_digit)
        odd = odd[pc.match_substring_regex(v.take(pa.array(odd)), labels.ODD.replace(":$", r":\z")).to_numpy(zero_copy_only=False)]
        for i in odd:
            found[i] = self.known.get(normal(v[int(i)].as_py()), -1)
        return found

    def __call__(self, tables: pa.Array) -> list[pa.Array]:
        """What tables say: the columns of ``READ``."""
        told, names = self.told(tables), pa.array(self.fields, pa.string())
        structured = told["structured"]
        pairs = _listed(told["pair_doc"], {"f": names.take(pa.array(told["pair_f"])), "v": told["pair_v"], "l": told["pair_l"]}, len(structured))
        heads = _listed(told["head_doc"], {"v": told["head_v"], "f": names.take(pa.array(told["head_f"]))}, len(structured), ~structured)
        return [pairs, heads, _listed(told["item_doc"], told["items"], len(structured), ~structured), told["totals"]]

    def told(self, tables: pa.Array) -> dict:
        """What tables say, each statement with its document: pairs, cells of heads, items; totals and ``structured``, whether there is a table of two rows and two columns, one for each document."""
        lengths = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        in_doc, flat = lengths(tables), tables.flatten()
        in_table, rows = lengths(flat), flat.flatten()
        in_row, cells = lengths(rows), rows.flatten()
        n_docs, n_tables, n_rows, n_cells = len(in_doc), len(in_table), len(in_row), len(cells)
        table_at, row_at = _starts(in_table), _starts(in_row)
        doc_of_table, table_of_row, row_of_cell = np.repeat(np.arange(n_docs), in_doc), np.repeat(np.arange(n_tables), in_table), np.repeat(np.arange(n_rows), in_row)
        column = np.arange(n_cells) - row_at[row_of_cell]
        v = pc.utf8_trim(pc.fill_null(cells, ""), characters=SPACE)
        filled, f = pc.greater(pc.binary_length(v), 0).to_numpy(zero_copy_only=False), self.labels(v)

        def count(cond: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(of[cond], minlength=n)

        named = count(f >= 0, row_of_cell, n_rows)
        # pairs: columns 1-2 and 4-5 of tables whose first row is no head
        first = np.where(in_table > 0, named[np.minimum(table_at[:-1], max(n_rows - 1, 0))] if n_rows else 0, 0)
        plain = np.flatnonzero(first[table_of_row] < 3)
        label = (row_at[plain][:, None] + np.array([0, 3])).ravel()
        label = label[np.tile([0, 3], len(plain)) + 1 < np.repeat(in_row[plain], 2)]
        label = label[(f[label] >= 0) & filled[label + 1]] if len(label) else label
        out = {"pair_doc": doc_of_table[table_of_row[row_of_cell[label]]], "pair_f": f[label], "pair_v": v.take(pa.array(label + 1)), "pair_l": v.take(pa.array(label))}
        # heads: the first of the rows with the highest score
        item_fields = np.isin(f, [self.no[x] for x in ITEM_FIELDS])
        score = named + 100 * (count(f == self.no["description"], row_of_cell, n_rows) > 0) + 50 * (count(item_fields, row_of_cell, n_rows) > 0)
        score = np.where(named >= 2, score, -1)
        best = np.full(n_tables, -1)
        np.maximum.at(best, table_of_row, score)
        tops = np.flatnonzero((score == best[table_of_row]) & (score > 0))
        having, at = np.unique(table_of_row[tops], return_index=True)
        head = np.full(n_tables, -1, np.int64)
        head[having] = tops[at]
        wide = count(in_row >= 2, table_of_row, n_tables) > 0
        structured = np.bincount(doc_of_table[(in_table > 1) & wide], minlength=n_docs) > 0
        used = (head >= 0) & structured[doc_of_table]
        at_head = np.flatnonzero(used[table_of_row[row_of_cell]] & (row_of_cell == head[table_of_row[row_of_cell]]) & (f >= 0)) if n_cells else np.zeros(0, np.int64)
        out |= {"structured": structured, "head_doc": doc_of_table[table_of_row[row_of_cell[at_head]]], "head_f": f[at_head], "head_v": v.take(pa.array(at_head))}
        # cells below a head, filled and in a column that it names
        below = used[table_of_row] & (np.arange(n_rows) > head[table_of_row])
        own = np.flatnonzero(below[row_of_cell] & filled)
        top = head[table_of_row[row_of_cell[own]]]
        inside = column[own] < in_row[top]
        own, top = own[inside], top[inside]
        field = f[row_at[top] + column[own]]
        own, field = own[field >= 0], field[field >= 0]
        # items: of each field the last cell of the row
        place = {x: np.full(n_rows, -1, np.int64) for x in ITEMS}
        for x, at in place.items():
            mine = own[field == self.no[x]]
            at[row_of_cell[mine]] = mine
        told = np.flatnonzero(place["description"] >= 0)
        name = v.take(pa.array(place["description"][told]))
        real = ~pc.or_(pc.match_substring_regex(pc.utf8_lower(name), "^(?:total|specimen)"), pc.is_in(name, pa.array(TOTAL_ARABIC))).to_numpy(zero_copy_only=False)
        told = told[real]

        def of(x: str) -> pa.Array:
            i = place[x][told]
            return v.take(pa.array(i, mask=i < 0))

        parsed = {x: of(x) if x in ("description", "lot") else whole(numbers(of(x))) if x in WHOLE else numbers(of(x)) for x in ITEMS}
        bare = np.flatnonzero(parsed["amount"].is_null().to_numpy(zero_copy_only=False))
        if len(bare):
            product = pc.multiply(parsed["unit_price"], parsed["cartons"].cast(pa.float64())).take(pa.array(bare)).to_pylist()
            amount = parsed["amount"].to_pylist()
            for i, p in zip(bare, product, strict=True):
                amount[i] = None if p is None else round(p, 2)
            parsed["amount"] = pa.array(amount, pa.float64())
        out |= {"item_doc": doc_of_table[table_of_row[told]], "items": parsed}
        # totals: the first number of each field in rows that say so
        says = pc.or_(pc.is_in(pc.utf8_lower(v), pa.array(TOTAL_WORDS)), pc.is_in(v, pa.array(TOTAL_ARABIC))).to_numpy(zero_copy_only=False)
        says = count(says, row_of_cell, n_rows) > 0
        of_total = says[row_of_cell[own]]
        own, field, sums = own[of_total], field[of_total], {}
        for x, title in SUMS.items():
            mine = own[field == self.no[x]]
            got = numbers(v.take(pa.array(mine)))
            got = whole(got) if x in WHOLE else got
            ok = got.is_valid().to_numpy(zero_copy_only=False)
            docs, at = np.unique(doc_of_table[table_of_row[row_of_cell[mine[ok]]]], return_index=True)
            index = np.full(n_docs, -1, np.int64)
            index[docs] = np.flatnonzero(ok)[at]
            sums[title] = got.take(pa.array(index, mask=index < 0))
        return out | {"totals": pa.StructArray.from_arrays(list(sums.values()), list(sums))}


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _listed(doc: np.ndarray, parts: dict[str, pa.Array], n_docs: int, null: np.ndarray | None = None) -> pa.Array:
    """Lists of structs, of rows that come in the order of their documents."""
    values = pa.StructArray.from_arrays(list(parts.values()), list(parts))
    offsets = pa.array(_starts(np.bincount(doc, minlength=n_docs)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def fixed_width(body: str) -> tuple[list[list[str | None]], list[str | None]]:
    """(items, totals) of a fixed-width packing list: of items the cells of lot, description, cartons, net and gross weight, of totals the last three.

    Columns are told by words in the header line, their places by the gaps of two or more spaces
    in the first data line.
    """
    lines, empty = body.split("\n"), [None] * 3
    has = lambda line, words: any(w in line.lower() for w in words)
    start = next((i for i, line in enumerate(lines) if has(line, HEADER_WORDS)), None)
    if start is None:
        return [], empty
    header, lines = lines[start], [(line, line.strip(SPACE)) for line in lines[start + 1 :]]
    data = [line for line, bare in lines if _DATA.match(bare)]
    names = [field for field, words in COLUMN_WORDS.items() if has(header, words)]
    first = data[0] if data else ""
    at = [i for i, sign in enumerate(first) if sign != " " and (i == 0 or first[max(i - 2, 0) : i] == "  ")]
    if len(at) < len(names):
        return [], empty

    def cut(line: str) -> dict[str, str]:
        cells = {name: line[at[i] : at[i + 1] if i + 1 < len(at) else len(line)].strip(SPACE) for i, name in enumerate(names)}
        return {name: v for name, v in cells.items() if v}

    items = [[c.get(name) for name in COLUMN_WORDS] for c in map(cut, data)] if len(names) >= 3 else []
    total = next((line for line, bare in lines if bare.lower().startswith("total")), None)
    summed = {} if total is None else {name: v for name, v in cut(total).items() if v.lower() != "total"}
    return items, [summed.get(name) for name in ("cartons", "net_kg", "gross_kg")]


class Merger(Reader):
    """What tables, pairs of the text, prose and fixed-width lists of a document say together: tables win over free text, free text over prose."""

    def __init__(self, known: dict[str, str], key_fields: tuple[str, ...], label_values: bool = False):
        super().__init__(known)
        self.key_fields, self.label_values, self.titles = key_fields, label_values, sorted(labels.fields())

    def fixed(self, texts: pa.Array, structured: np.ndarray):
        """(document, items) of fixed-width lists, of documents without tables, and totals for each document."""
        doc, items, sums = [], [], [[None] * 3] * len(texts)
        found = pc.fill_null(pc.match_substring_regex(texts, DATA_LINE), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(found):
            own, sums[i] = fixed_width(texts[int(i)].as_py())
            if not structured[i]:
                doc += [i] * len(own)
                items += own
        cells = {x: pa.array([c[i] for c in items], pa.string()) for i, x in enumerate(COLUMN_WORDS)}
        sums = {x: numbers(pa.array([s[i] for s in sums], pa.string())) if found.any() else pa.nulls(len(texts), pa.float64()) for i, x in enumerate(("cartons", "net_kg", "gross_kg"))}
        read = lambda x: whole(numbers(cells[x])) if x in WHOLE else numbers(cells[x])
        parts = {x: cells[x] if x in ("description", "lot") else read(x) if x in cells else pa.nulls(len(items), pa.int64() if x in WHOLE else pa.float64()) for x in ITEMS}
        totals = [whole(v) if x in WHOLE else v for x, v in sums.items()]
        return np.array(doc, np.int64), parts, pa.StructArray.from_arrays(totals, list(sums))

    def merge(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """One column for each key field, and those of ``MERGED``."""
        n, told = batch.num_rows, self.told(batch.column("tables"))
        pairs, said = batch.column("_text"), batch.column("_said")
        in_text, stated = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False), pairs.flatten()
        text_doc = np.repeat(np.arange(n), in_text)
        text_f = pc.fill_null(pc.index_in(pc.struct_field(stated, "f"), pa.array(self.fields, pa.string())), -1).to_numpy(zero_copy_only=False)
        prose = {f.name: pc.struct_field(said, f.name) for f in said.type} if said.null_count < n else {}
        values = [told["pair_v"], pc.struct_field(stated, "v"), *prose.values()]
        shown = values if self.label_values else [told["pair_l"], pc.struct_field(stated, "l"), *(pc.if_else(c.is_valid(), name, pa.scalar(None, pa.string())) for name, c in prose.items())]

        def first(name: str, sources: list, heads: bool = False) -> np.ndarray:
            """For each document the place of what is said of a field in all sources one after the other, or -1; what goes before wins, in the text what comes last."""
            out, no = np.full(n, -1, np.int64), self.no.get(name, -2)
            at = _starts(np.array([len(c) for c in sources]))
            if name in prose:
                i = list(prose).index(name) + 2
                there = np.flatnonzero(prose[name].is_valid().to_numpy(zero_copy_only=False))
                out[there] = at[i] + there
            mine = np.flatnonzero(text_f == no)
            out[text_doc[mine]] = at[1] + mine
            mine = np.flatnonzero(told["pair_f"] == no)[::-1]
            out[told["pair_doc"][mine]] = mine
            if heads:
                mine = np.flatnonzero(told["head_f"] == no)[::-1]
                out[told["head_doc"][mine]] = at[-1] + mine
            return out

        every = pa.concat_arrays([c.cast(pa.string()) for c in values])
        keys = []
        for name in self.key_fields:
            at = first(name, values)
            keys.append(every.take(pa.array(at, mask=at < 0)))
        at = np.stack([first(name, shown, True) for name in self.titles], axis=1)
        there = at >= 0
        every = pa.concat_arrays([c.cast(pa.string()) for c in (*shown, told["head_v"])])
        names = pa.array(self.titles, pa.string()).take(pa.array(np.nonzero(there)[1]))
        found = pa.MapArray.from_arrays(pa.array(_starts(there.sum(axis=1)).astype(np.int32)), names, every.take(pa.array(at[there])))
        doc, items, fixed_totals = self.fixed(batch.column("text"), told["structured"])
        if len(doc):
            doc = np.concatenate([told["item_doc"], doc])
            order = np.argsort(doc, kind="stable")
            items = {x: pa.concat_arrays([told["items"][x], items[x]]).take(pa.array(order)) for x in ITEMS}
            doc = doc[order]
        else:
            doc, items = told["item_doc"], told["items"]
        return [*keys, found, _listed(doc, items, n), told["totals"], fixed_totals]


def merged(docs: DataFrame, known: dict[str, str], key_fields: tuple[str, ...], label_values: bool = False) -> DataFrame:
    """``docs`` with a column for each of ``key_fields`` and ``MERGED`` in place of (text, tables, _text, _said), its last four columns.

    ``_text`` has the label-value pairs of the text, (f, v, l) in their order, ``_said`` what prose says, a struct of fields; both may be null.
    """
    kept = [c for c in docs.columns if c not in ("text", "tables", "_text", "_said")]

    def work(batches):
        merger = Merger(known, key_fields, label_values)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, AT_ONCE):
                batch = whole_batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *merger.merge(batch)], [*kept, *(f"_{f}" for f in key_fields), *MERGED])

    shape = docs.select(*kept, *[F.lit(None).cast("string").alias(f"_{f}") for f in key_fields], *[F.lit(None).cast(kind).alias(name) for name, kind in MERGED.items()]).schema
    return docs.select(*kept, "text", "tables", "_text", "_said").mapInArrow(work, shape)


def read(docs: DataFrame, known: dict[str, str]) -> DataFrame:
    """``docs`` with what their tables say (``READ``) in place of these; pairs of tables without a head, and of the others heads, items and totals, null for documents that have no table of two rows and two columns."""
    kept = [c for c in docs.columns if c != "tables"]

    def work(batches):
        reader = Reader(known)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, AT_ONCE):
                batch = whole_batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *reader(batch.column(len(kept)))], [*kept, *READ])

    shape = docs.select(*kept, *[F.lit(None).cast(kind).alias(name) for name, kind in READ.items()]).schema
    return docs.select(*kept, "tables").mapInArrow(work, shape)
