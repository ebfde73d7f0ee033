"""Elements of cut XML texts, by array operations over the tokens of many texts at once.

Tokens follow each other without gaps, so a place is an index into the bytes of
all texts, and lines and columns are differences of running sums over these. All
steps are linear but for one sort; only the scopes of namespaces are followed
element by element, in texts that declare any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18

_IN_NAMES = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.:-"))
_BLANK = np.isin(np.arange(256), list(b" \t\n\r"))


def _before(counts: np.ndarray) -> np.ndarray:
    """At each place the sum of what lies before it; a batch of strings has less than 2**31 bytes."""
    sums = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, dtype=np.int32, out=sums[1:])
    return sums


def _next(flags: np.ndarray) -> np.ndarray:
    """At each place the first flag at or after it."""
    at = np.where(flags, np.arange(len(flags), dtype=np.int32), np.int32(len(flags)))
    return np.minimum.accumulate(at[::-1])[::-1]


def _bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one range after the other."""
    return data[np.repeat(starts - _before(lengths)[:-1], lengths) + np.arange(lengths.sum(), dtype=np.int32)]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray | None = None, n: int = 0) -> pa.Array:
    """Ranges as strings, or those of each owner (ascending) joined as one of ``n``."""
    lengths = ends - starts
    sizes = lengths if owner is None else np.bincount(owner, lengths, n).astype(np.int64)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(_before(sizes).astype(np.int32)), pa.py_buffer(_bytes(data, starts, lengths)))


def _or_null(known: np.ndarray, values: pa.Array) -> pa.Array:
    return pc.if_else(pa.array(known), values, pa.scalar(None, values.type))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_before(counts), pa.int32()), values)


def _openers(doc: np.ndarray, before: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each token the last opener of its text one level above, or -1."""
    token = np.repeat(np.arange(len(doc)), 1 + opens)  # every token asks, and openers give after that
    gives = np.concatenate(([False], token[1:] == token[:-1]))
    group = before[token] - 1 + gives
    key = doc[token] * (group.max() - group.min() + 1) + group - group.min()
    order = np.argsort(key, kind="stable")
    token, gives, key, at = token[order], gives[order], key[order], np.arange(len(order))
    begin = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
    last = np.maximum.accumulate(np.where(gives, at, -1))
    found = np.full(len(doc), -1)
    found[token[~gives]] = np.where(last >= begin, token[last], -1)[~gives]
    return found


def _split(data: np.ndarray, colon: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Names with their prefixes (null without a colon) and local names."""
    at = colon[starts]
    has = at < ends
    return [_strings(data, starts, ends), _or_null(has, _strings(data, starts, np.where(has, at, starts))), _strings(data, np.where(has, at + 1, starts), ends)]


def _scopes(doc: np.ndarray, last: np.ndarray, own: np.ndarray, tags: pa.Array, counts: np.ndarray, names: pa.Array, values: pa.Array, declares: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The namespaces of elements and of attributes: the nearest declaration around them."""
    of_tags, of_names, first = [None] * len(doc), [None] * len(names), _before(counts)
    held: dict[tuple[int, str], list[tuple[int, str]]] = {}

    def nearest(at: int, prefix: str) -> str | None:
        stack = held.get((doc[at], prefix), [])
        while stack and stack[-1][0] < own[at]:
            stack.pop()
        return stack[-1][1] if stack else None

    with_any = np.isin(doc, doc[np.repeat(np.arange(len(doc)), counts)[declares]])
    for at in np.flatnonzero(with_any):
        attributes = range(first[at], first[at + 1])
        for j in attributes:
            if declares[j]:
                prefix = names[j].as_py()[6:]
                nearest(at, prefix)
                held.setdefault((doc[at], prefix), []).append((last[at], values[j].as_py()))
        prefix, colon, _ = tags[at].as_py().partition(":")
        of_tags[at] = nearest(at, prefix if colon else "")
        for j in attributes:
            prefix, colon, _ = names[j].as_py().partition(":")
            if colon and not declares[j]:
                of_names[j] = nearest(at, prefix)
    return pa.array(of_tags, pa.string()), pa.array(of_names, pa.string())


def _elements(tokens: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Elements of sound texts: which text each is of, and their columns."""
    flat, counts = tokens.flatten(), pc.list_value_length(tokens).to_numpy()
    n, first = len(flat), _before(counts)[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    edges = np.frombuffer(flat.buffers()[1], np.int32, n + 1, 4 * flat.offset).astype(np.int64)
    texts = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    data, edges = np.concatenate((texts, np.zeros(4, np.uint8))), edges - edges[0]
    start, end = edges[:-1], edges[1:]

    coded = _before(data == 38)
    units, breaks, filled = _before(((data & 0xC0) != 0x80).astype(np.int8) + (data >= 0xF0)), _before(data == 10), _before(~_BLANK[data])
    line_start = np.concatenate(([0], np.maximum.accumulate(np.where(data == 10, np.arange(1, len(data) + 1, dtype=np.int32), np.int32(0)))), dtype=np.int32)
    name_end, solid, colon, double, simple = _next(~_IN_NAMES[data]), _next(~_BLANK[data]), _next(data == 58), _next(data == 34), _next(data == 39)

    def place(at: np.ndarray, text: np.ndarray) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in (breaks[at] - breaks[text] + 1, units[at] - units[np.maximum(line_start[at], text)] + 1)]

    # Kinds of tokens, as in ``operators.markup``.
    b0, b1, b2, length = data[start], data[start + 1], data[start + 2], end - start
    final, text, marked = length == 0, (length > 0) & (b0 != 60), (length > 1) & (b0 == 60)
    other = marked & (b1 == 33)
    section, doctype = other & (b2 == 91), other & (b2 != 91) & (b2 != 45)
    closes = marked & (b1 == 47)
    tag = marked & (b1 != 33) & (b1 != 47) & (b1 != 63)
    opens = tag & (data[end - 2] != 47)

    def within(running: np.ndarray) -> np.ndarray:
        return running - running[first][doc]

    before = within(_before(opens.astype(np.int8) - closes)[:-1])
    node = within(_before(tag)[:-1])
    over = within(_before(closes & (before <= 1) | tag & ~opens & (before == 0))[:-1]) > 0
    inside, opener = before > 0, _openers(doc, before, opens)

    name_at = start + 1 + closes
    size = name_end[np.minimum(name_at, len(data) - 1)] - name_at
    ending = np.flatnonzero(inside & closes & (opener >= 0))
    differs = size[ending] != size[opener[ending]]
    same = np.flatnonzero(~differs)
    lengths = size[ending[same]]
    unequal = _bytes(data, name_at[ending[same]], lengths) != _bytes(data, name_at[opener[ending[same]]], lengths)
    differs[same] = np.bincount(np.repeat(np.arange(len(same)), lengths), unequal, len(same)) > 0
    mismatch = np.zeros(n, bool)
    mismatch[ending] = differs
    stray = ~inside & (text & (filled[end] > filled[start]) | final)
    broken = (length == 1) & (b0 == 60) | doctype & inside | closes & ~inside
    wrong = ~over & (stray | broken | mismatch | inside & final)
    kept = ~over & (np.bincount(doc, wrong, len(counts)) == 0)[doc]

    found = np.flatnonzero(kept & tag)
    rank = np.full(n, -1)
    rank[found] = np.arange(len(found))
    of, above = doc[found], opener[found]
    parts = np.flatnonzero(kept & (text | section) & (opener >= 0))
    owner = rank[opener[parts]]
    parts = parts[order := np.argsort(owner, kind="stable")]
    content = _strings(data, start[parts] + 9 * section[parts], end[parts] - 3 * section[parts], owner[order], len(found))

    # A tag's attributes one after the other, of all tags at once.
    at, live, cut = name_end[name_at[found]], np.arange(len(found)), []
    while len(live):
        name = solid[at[live]]
        live, name = live[more := _IN_NAMES[data[name]]], name[more]
        stop = name_end[name]
        quote = solid[solid[stop] + 1]
        shut = np.where(data[quote] == 34, double[quote + 1], simple[quote + 1])
        cut.append((live, name, stop, quote + 1, shut))
        at[live] = shut + 1
    holder, name, stop, value, shut = (np.concatenate(x) for x in zip(*cut)) if cut else [np.zeros(0, np.int64)] * 5
    order = np.argsort(holder, kind="stable")
    holder, name, stop, value, shut = (x[order] for x in (holder, name, stop, value, shut))
    held = np.bincount(holder, minlength=len(found))
    declares = stop - name >= 5
    for i, letter in enumerate(b"xmlns"):
        declares &= data[np.minimum(name + i, len(data) - 1)] == letter
    declares &= (stop - name == 5) | (data[np.minimum(name + 5, len(data) - 1)] == 58)

    text_at, with_entity = start[first][of], coded[end[found]] > coded[start[found]]
    tags, names = _split(data, colon, name_at[found], name_end[name_at[found]]), _split(data, colon, name, stop)
    values = _strings(data, value, shut)
    if declares.any():
        last = np.array(found)
        ended = np.flatnonzero(kept & closes & (opener >= 0))
        last[rank[opener[ended]]] = ended
        spaces, name_spaces = _scopes(of, last, found, tags[0], held, names[0], values, declares)
        with_entity |= np.bincount(holder, pc.fill_null(pc.match_substring(name_spaces, "&"), False).to_numpy(zero_copy_only=False), len(found)) > 0
    else:
        spaces, name_spaces = pa.nulls(len(found), pa.string()), pa.nulls(len(name), pa.string())
    names[1] = _or_null(~declares, names[1])
    attributes = pa.StructArray.from_arrays([*names, name_spaces, values, *place(name, text_at[holder])], ["name", "prefix", "local_name", "namespace", "value", "line", "column"])
    cells = [pa.array(node[found], pa.int64()), _or_null(above >= 0, pa.array(node[above], pa.int64())), pa.array(before[found], pa.int32()), *tags, spaces, *place(start[found], text_at), _lists(held, attributes), content, pa.array(with_entity)]
    return of, dict(zip(["node", "parent", "depth", "tag", "prefix", "local_name", "namespace", "line", "column", "attributes", "text", "coded"], cells))


def _families(of: np.ndarray, columns: dict[str, pa.Array]) -> tuple[list[pa.Array], pa.Array]:
    """For elements of texts ``of``: how many brothers of the same local name come before, where the list of each text has their children, and how many; and these lists of nodes, parent by parent."""
    n, node, child = len(of), columns["node"].to_numpy(), columns["parent"].is_valid().to_numpy(zero_copy_only=False)
    first = np.searchsorted(of, of)
    parent = np.where(child, first + columns["parent"].fill_null(0).to_numpy(), n + of)
    name = columns["local_name"].dictionary_encode().indices.to_numpy()
    order = np.lexsort((name, parent))
    begins = np.concatenate(([True], (np.diff(parent[order]) != 0) | (np.diff(name[order]) != 0)))
    nth = np.zeros(n, np.int64)
    nth[order] = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    children = np.bincount(parent[child], minlength=n)
    at = _before(children)[:-1]
    order = np.argsort(parent, kind="stable")
    by_parent = node[order[child[order]]]
    counts = np.bincount(of[child], minlength=of[-1] + 1)[np.unique(of)]
    return [pa.array(x, pa.int32()) for x in (nth, at - at[first], children)], _lists(counts, pa.array(by_parent, pa.int32()))


def rows(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Elements of sound texts (path, doc, tokens): a row each, or with ``whole`` a row for each text."""
    for batch in batches:
        tokens = batch.column("tokens")
        lengths = pc.binary_length(tokens.flatten()).to_numpy()
        ends = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        chunk = _before(lengths)[ends[:-1]] // CHUNK
        for number in np.unique(chunk):
            low, high = np.searchsorted(chunk, [number, number + 1])
            of, columns = _elements(tokens.slice(low, high - low))
            if not len(of):
                continue
            taken = pa.array(low + of)
            if whole:
                texts, counts = np.unique(of, return_counts=True)
                family, by_parent = _families(of, columns)
                columns |= dict(zip(["nth", "child_at", "children"], family))
                columns = {"elements": _lists(counts, pa.StructArray.from_arrays(list(columns.values()), list(columns))), "by_parent": by_parent}
                taken = pa.array(low + texts)
            yield pa.RecordBatch.from_arrays([batch.column("path").take(taken), batch.column("doc").take(taken), *columns.values()], ["path", "doc", *columns])
