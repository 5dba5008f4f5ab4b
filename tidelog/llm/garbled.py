"""Garbled text from wrong character encoding.

Method: expectation-maximization with latent encoding chains. A chain is one or two steps of writing
text in one encoding and reading it in another; the identity is the chain of clean text. Each token
with characters beyond ASCII has a latent chain. Its prior belongs to the token's source and field
(title, body, foot), so weak evidence is pooled across records; its likelihood is that of the
repaired token under a character model, which is itself estimated from the expected clean tokens of
the whole corpus. After the last round each record's tokens are judged, and repaired, by posterior.

All state that is sent around has a fixed size: hashed trigram, bigram and character counts, and
one prior per chain for each of SOURCE_BUCKETS times three fields.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.skew import lookup_join
from tidelog.operators.small_files import packed_read
from tidelog.session import cut, shared_path

#: Encodings with one byte a character beyond ASCII, in which pages are written or read.
SINGLE = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-15", "mac_roman", "cp437", "cp850", "koi8-r"]
#: Encodings with several bytes a character.
MULTI = ["cp932", "gb18030"]
#: Those of SINGLE whose letters beyond ASCII make up whole words.
OTHER_SCRIPTS = ["cp1251", "cp1253", "koi8-r"]
#: Wrong readings that are undone a second time.
TWICE = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850"]
IDENTITY = 0
LOST = "lost"
CHAINS = (
    ["clean", LOST]
    + [f"{d}>utf-8" for d in SINGLE + MULTI]
    + [f"{d}>{e}" for d in SINGLE for e in SINGLE + MULTI if d != e]
    + [f"{d}>{e}" for d in MULTI for e in SINGLE + MULTI if d != e]
    + [f"{a}>utf-8 {b}>utf-8" for a in SINGLE for b in TWICE]
)
NUMBER = {c: i for i, c in enumerate(CHAINS)}
SOURCE_BUCKETS, FIELDS = 64, 3
TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
SIZE = TRI + BI + UNI
#: Natural logs by which a C1 control, which no clean text has, speaks against the identity.
CONTROL = 8.0
#: Natural logs by which each symbol inside a word, letters of two scripts side by side or four accented letters in a
#: row speak against a text, and how many such places count.
ODD, MOST_ODD = 6.0, 2
#: Log odds before any evidence that a document is altered by a chain without UTF-8 that the priors do not know.
UNKNOWN = -9.0
#: The same where they know it: of a thousand documents about one is altered by any one of such chains.
KNOWN = -7.0
#: Occurrences from which on a word is held against being the altered form of a word that is no more frequent, and the
#: places of each of the two rows in which words are counted by hash.
OFTEN, WORDS = 3, 1 << 21
#: Evidence of a token that a chain turns into what no text has, or that the chain's reading cannot have produced.
AGAINST = -25.0
#: Weight of the shorter context in the character model.
BACK_OFF = 4.0
ROUNDS = 6

_C1 = re.compile("[\x80-\x9f]")


def _chars(enc: str) -> list[str]:
    """The character of each byte 128..255; where the encoding has none, the C1 control of that number."""
    return [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(128, 256)]


TABLE = {d: "".join(map(chr, range(128))) + "".join(_chars(d)) for d in SINGLE}
MAP = {d: codecs.charmap_build(t) for d, t in TABLE.items()}


def _utf8_pattern(d: str) -> re.Pattern:
    """What UTF-8 sequences look like where they were read as d."""
    of = lambda lo, hi: "[" + re.escape(TABLE[d][lo : hi + 1]) + "]"
    c = of(0x80, 0xBF)
    return re.compile(f"{of(0xC2, 0xDF)}{c}|{of(0xE0, 0xEF)}{c}{c}|{of(0xF0, 0xF4)}{c}{c}{c}")


UTF8 = {d: _utf8_pattern(d) for d in SINGLE}
_BOM = "\ufeff"
#: A byte order mark as each encoding reads it; it belongs to the word behind it.
BOMS = tuple({"".join(TABLE[d][x] for x in _BOM.encode()) for d in SINGLE})


def _utf8(token: str, d: str) -> str | None:
    """token with every valid UTF-8 sequence that its reading as d shows put right; None if it shows none."""
    pattern = UTF8[d]
    if not pattern.search(token):
        return None

    def turn(m: re.Match) -> str:
        try:
            return codecs.charmap_encode(m[0], "strict", MAP[d])[0].decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    v = pattern.sub(turn, token).lstrip(_BOM)
    return v if v != token else None


_WIDE = re.compile("[\u1100-\ud7ff\uf900-\ufaff\uff00-\uffef]")
_PRIVATE = re.compile("[\ue000-\uf8ff]")
_BEYOND = re.compile("[^\x00-\x7f]")
_LETTER = re.compile("[A-Za-z]")


def _multi(b: bytes, e: str) -> str | None:
    """b read as e, a broken last character being left out; None unless most of it is wide characters."""
    try:
        v = b.decode(e)
    except UnicodeDecodeError as x:
        if x.start < len(b) - 1 or len(b) < 6:
            return None
        v = b[: x.start].decode(e)
    if e in MULTI and (2 * len(_WIDE.findall(v)) < len(_BEYOND.findall(v)) + len(_LETTER.findall(v)) or _PRIVATE.search(v)):
        return None
    return v


_STEP = {d: {e: NUMBER[c] for e in [*SINGLE, *MULTI, "utf-8"] if (c := f"{d}>{e}") in NUMBER} for d in [*SINGLE, *MULTI]}
_STEPS = {a: {b: NUMBER[f"{a}>utf-8 {b}>utf-8"] for b in TWICE} for a in SINGLE}


def _joints(v: str) -> int:
    """Unbreakable spaces and soft hyphens; a letter that is read as one of these is no repair, the words would only fall apart."""
    return v.count("\xa0") + v.count("\xad")


def repairs(token: str) -> dict[str, list[int]]:
    """Each text that the token may have been, with the chains that lead from it to the token."""
    out: dict[str, list[int]] = {}

    def add(v: str | None, chain: int) -> None:
        if v and v != token and not v.isspace():
            if v in out:
                out[v].append(chain)
            else:
                out[v] = [chain]

    first: dict[str, str] = {}
    read: dict[bytes, list[str]] = {}
    for d in SINGLE:
        v = _utf8(token, d)
        if v:
            first[d] = v
            add(v, _STEP[d]["utf-8"])
        try:
            read.setdefault(codecs.charmap_encode(token, "strict", MAP[d])[0], []).append(d)
        except UnicodeEncodeError:
            pass
    for raw, ds in read.items():
        for e in SINGLE:
            v = codecs.charmap_decode(raw, "strict", TABLE[e])[0]
            if v != token and not _C1.search(v) and _joints(v) <= _joints(token):
                for d in ds:
                    if d != e:
                        add(v, _STEP[d][e])
        if len(raw) > 1:
            for e in MULTI:
                v = _multi(raw, e)
                for d in ds if v else ():
                    add(v, _STEP[d][e])
    for a, v in first.items():
        if not v.isascii():
            for b in TWICE:
                add(_utf8(v, b), _STEPS[a][b])
    if max(token) >= "\u3000":
        for d in MULTI:
            try:
                raw = token.encode(d)
            except UnicodeEncodeError:
                continue
            add(_multi(raw, "utf-8"), _STEP[d]["utf-8"])
            other = MULTI[1 - MULTI.index(d)]
            add(_multi(raw, other), _STEP[d][other])
            # words of Latin scripts are mostly of letters that every encoding leaves as they are
            for e in SINGLE if _LETTER.search(token) else OTHER_SCRIPTS:
                v = codecs.charmap_decode(raw, "strict", TABLE[e])[0]
                if not _C1.search(v) and not _joints(v):
                    add(v, _STEP[d][e])
    return out


_SCRIPTS = ("a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\u0370-\u03ff", "\u0400-\u052f")
_SIGNS = "\u00a2-\u00a9\u00ac\u00ae-\u00b1\u00b4\u00b6\u00b8\u00bc-\u00bf\u00a1\u00d7\u00f7\u02c6\u02c7\u02d8-\u02dd\u2021\u2026\u2030\u20ac\u2200-\u22ff\u2500-\u25ff\ufb01\ufb02"
_ANY = "".join(_SCRIPTS)
_ODD = re.compile(
    "|".join(
        [f"(?<=[{_ANY}])[{_SIGNS}\u00b2\u00b3\u00b9](?=[{_ANY}])", f"(?<![^\\s])[\u00bc-\u00be\u00b2\u00b3\u00b9](?=[a-z]{{2}})", "[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{4}"]
        + [f"(?<=[{a}])(?=[{b}])" for a in _SCRIPTS for b in _SCRIPTS if a != b]
    )
)


_SIGN = re.compile(f"[{_SIGNS}\u00b2\u00b3\u00b9]|[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{{4}}")
_OF_SCRIPT = [re.compile(f"[{x}]") for x in _SCRIPTS]


def odd(v: str) -> float:
    """What symbols inside a word, mixed scripts and runs of accents speak against v, in natural logs."""
    if v.isascii() or not _SIGN.search(v) and sum(bool(x.search(v)) for x in _OF_SCRIPT) < 2:
        return 0.0
    return ODD * min(MOST_ODD, len(_ODD.findall(v)))


_DIGITS = re.compile("[0-9]+")
_RUN = re.compile(r"(.)\1{3,}")


#: What stands between words joined by a space that does not break: the end of one and the start of the next.
_JOINT = "\x03\x02\x02"


def shape(v: str) -> str:
    """What the character model sees: digits as one, and lower case where case is as in ordinary writing.

    A character repeated on and on is seen three times. Words joined by a space that does not break, or by
    a soft hyphen, are seen one by one.
    """
    if "\xad" in v or "\xa0" in v:
        return _JOINT.join(shape(w) for w in v.replace("\xad", "\xa0").split("\xa0") if w)
    v = _RUN.sub(r"\1\1\1", _DIGITS.sub("0", v))
    low = v.lower()
    if v != low:
        i = next((i for i, c in enumerate(v) if c.isalpha()), 0)
        if v[i + 1 :] == low[i + 1 :] or v == v.upper():
            return low
    return v


def features(shapes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character and end mark of all texts, given by their shapes: its text, and the places of its trigram,
    the two-character context, its bigram, the one-character context and itself in the count table."""
    joined = "\x02\x02" + "\x03\x02\x02".join(shapes) + "\x03" if shapes else ""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) + 3 for t in shapes], dtype=np.int64)
    which = np.repeat(np.arange(len(shapes)), np.diff(ends, prepend=0))
    start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    at = np.arange(len(c))
    # what stands between joined words is no event
    real = (at - start[which] >= 2) & (c != 2)
    p1, p2 = np.roll(c, 1), np.roll(c, 2)
    mix = lambda x, m: ((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - m)).astype(np.int64)
    k21 = (p2 << np.uint64(21)) | p1
    tri = mix((k21 << np.uint64(21)) ^ (k21 >> np.uint64(11)) ^ c, 20)
    ctx2 = TRI + mix(k21 + np.uint64(1), 18)
    bi = TRI + mix(((p1 << np.uint64(21)) | c) + np.uint64(1), 18)
    ctx1 = TRI + BI + mix(p1 + np.uint64(7), 16)
    uni = TRI + BI + mix(c + np.uint64(7), 16)
    return which[real], tri[real], ctx2[real], bi[real], ctx1[real], uni[real]


#: Characters that are looked up together, which bounds a task's memory.
CHARACTERS = 1 << 18


def likelihoods(shapes: list[str], counts: np.ndarray) -> np.ndarray:
    """Log probability of each text, given by its shape, under the counts."""
    ends = np.cumsum([len(v) + 3 for v in shapes])
    if len(shapes) > 1 and ends[-1] > CHARACTERS:
        edges = [0]
        while edges[-1] < len(shapes):
            before = ends[edges[-1] - 1] if edges[-1] else 0
            edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, before + CHARACTERS))))
        return np.concatenate([likelihoods(shapes[a:z], counts) for a, z in zip(edges, edges[1:])])
    which, tri, ctx2, bi, ctx1, uni = features(shapes)
    total = counts[TRI + BI :].sum() + UNI
    p = (counts[uni] + 0.5) / total
    p = (counts[bi] + BACK_OFF * p) / (counts[ctx1] + BACK_OFF)
    p = (counts[tri] + BACK_OFF * p) / (counts[ctx2] + BACK_OFF)
    return np.bincount(which, np.log(p), minlength=len(shapes))


def expected_counts(shapes: list[str], weights: np.ndarray, into: np.ndarray) -> None:
    """Add the trigrams, bigrams and characters of texts, given by their shapes, by weight."""
    which, tri, _, bi, _, uni = features(shapes)
    w = weights[which]
    for at in (tri, bi, uni):
        into += np.bincount(at, w, minlength=SIZE)


#: Whether a chain undoes UTF-8, whose sequences are evidence by their form alone.
BY_FORM = np.array(["utf-8" in c for c in CHAINS])


def start_prior() -> np.ndarray:
    """Clean 0.6, chains with UTF-8 0.35 and the others 0.05: the garbled part leaves the counts in the first rounds."""
    p = np.where(BY_FORM, 0.35 / BY_FORM.sum(), 0.05 / (len(CHAINS) - 1 - BY_FORM.sum()))
    p[IDENTITY] = 0.6
    return np.tile(p, (SOURCE_BUCKETS * FIELDS, 1))


def posteriors(owner: np.ndarray, logs: np.ndarray, flat: np.ndarray, of: np.ndarray, sf_owner: np.ndarray, sf: np.ndarray, prior: np.ndarray):
    """Posterior of each candidate of each (token, source and field): pair, candidate and posterior.

    owner: the token of each candidate, ascending; logs: its log likelihood; flat, of: all candidates'
    chains and the candidates that they belong to; sf_owner, sf: the (token, source-field) pairs.
    """
    n_c = np.bincount(owner, minlength=owner[-1] + 1)
    first = np.cumsum(n_c) - n_c
    reps = n_c[sf_owner]
    pair = np.repeat(np.arange(len(sf)), reps)
    cand = first[sf_owner][pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(reps) - reps, reps))
    # sum of priors over each candidate's chains
    used, inverse = np.unique(sf, return_inverse=True)
    mass = np.stack([np.bincount(of, prior[u][flat], minlength=len(owner)) for u in used])
    s = logs[cand] + np.log(mass[inverse[pair], cand])
    top = np.full(len(sf), -np.inf)
    np.maximum.at(top, pair, s)
    e = np.exp(s - top[pair])
    return pair, cand, e / np.bincount(pair, e, minlength=len(sf))[pair]


# --- over tables ---

#: Rows of a model that are sent to the driver at most, by construction: one per place of the count table and per prior.
STATS = SIZE + SOURCE_BUCKETS * FIELDS * len(CHAINS)
#: Bytes of a table of types that one task reads at most: four times what a task can give of a model, twelve bytes a place.
SPLIT_BYTES = 48 * STATS
#: Natural logs by which a candidate may trail the best one in the first round without being dropped.
TRAIL = 25.0
_TOKEN = re.compile("[^ \t\r\f\v]*[^\x00-\x7f][^ \t\r\f\v]*")
_MARKS = "“”„\"'‚‘’«»‹›().,;:!?¿¡<>[]{}|*_ \xa0\xad"
OCC = "doc_id bigint, line int, sf int, token string, place int, core string, prev string, next string"
CONTEXT = "doc_id bigint, line int, place int, core string, prev string, next string"
HITS = "token string, sf int, repaired string, meant bigint, letter string, chain string, p double, llr double, most double, kind string"
#: A run without wide characters that has a letter or sign of the smaller scripts: such a run within a text of wide
#: characters, which needs no spaces, is a token of its own.
_WIDE_SET = "\u1100-\u11ff\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff\uff00-\uffef"
_INLAY = re.compile(f"[^{_WIDE_SET}]*[\x80-\u024f\u0370-\u052f][^{_WIDE_SET}]*")
_HAS_WIDE = re.compile(f"[{_WIDE_SET}]")


def core(w: str) -> str:
    """A token without the marks around it; a token of marks alone stays."""
    return w.strip(_MARKS) or w


def tokens_of(line: str) -> Iterator[tuple[int, int]]:
    """Start and end of every token with characters beyond ASCII: runs without white space, cut where a run of wide
    characters meets one of the smaller scripts."""
    for m in _TOKEN.finditer(line):
        a, z = m.span()
        if not _HAS_WIDE.search(line, a, z):
            yield a, z
            continue
        at = a
        for x in _INLAY.finditer(line, a, z):
            if x[0] in BOMS:
                continue
            if x.start() > at and not line[at : x.start()].isascii():
                yield at, x.start()
            yield x.span()
            at = x.end()
        if at < z and not line[at:z].isascii():
            yield at, z


def _named(w: str) -> str:
    """A neighbour, digits as one; one of unusual length by its hash, so that rows stay narrow."""
    w = _DIGITS.sub("0", w)
    return w if len(w) <= 64 else "#" + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def neighbours(line: str, a: int, z: int) -> tuple[str, str]:
    """The words before and after a token; ^ and $ stand for a line's ends."""
    j = a
    while j and line[j - 1].isspace():
        j -= 1
    i = j
    while i and not line[i - 1].isspace():
        i -= 1
    k, n = z, len(line)
    while k < n and line[k].isspace():
        k += 1
    m = k
    while m < n and not line[m].isspace():
        m += 1
    return _named(line[i:j]) or "^", _named(line[k:m]) or "$"


def occurrences(text: str) -> Iterator[tuple[int, int, str, int, str | None, str | None, str | None]]:
    """(line, field, token, place, core, prev, next) of every token with characters beyond ASCII.

    Fields: 0 first line, 2 last line, 1 between; a text of one line is a first line. place is the
    number of such tokens before it in the line. A token that is one character but for the marks
    around it comes with this core and its neighbours: how such characters stand in the corpus tells
    examples from damage.
    """
    lines = text.split("\n")
    last = len(lines) - 1
    for i, l in enumerate(lines):
        if l.isascii():
            continue
        field = 0 if i == 0 else 2 if i == last else 1
        for place, (a, z) in enumerate(tokens_of(l)):
            w = l[a:z]
            c = core(w)
            if len(c) == 1:
                yield i, field, w, place, c, *neighbours(l, a, z)
            else:
                yield i, field, w, place, None, None, None


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core and neighbours of every token of some documents."""
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for i, l in enumerate((text or "").split("\n")):
                if not l.isascii():
                    rows += [(doc, i, n, core(l[a:z]), *neighbours(l, a, z)) for n, (a, z) in enumerate(tokens_of(l))]
        if rows:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], ["doc_id", "line", "place", "core", "prev", "next"])


def bucket(source: str | None) -> int:
    """Place of a source's priors; sources beyond SOURCE_BUCKETS share places, so the model stays of one size."""
    return zlib.crc32(source.encode()) % (SOURCE_BUCKETS - 1) + 1 if source is not None else 0


def _find_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("sf", pa.int32()), ("token", pa.string()), ("place", pa.int32()), ("core", pa.string()), ("prev", pa.string()), ("next", pa.string())])

    def flush(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for b in batches:
        columns: list[list] = [[] for _ in schema]
        ids, at_line, sfs, tokens, many, cores, before, after = columns
        for i, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text and not text.isascii():
                s = bucket(source) * FIELDS
                for line, f, w, n, c, p, q in occurrences(text):
                    ids.append(i)
                    at_line.append(line)
                    sfs.append(s + f)
                    tokens.append(w)
                    cores.append(c)
                    many.append(n)
                    before.append(p)
                    after.append(q)
            if len(ids) > 50_000:
                yield flush(columns)
                for c in columns:
                    c.clear()
        if ids:
            yield flush(columns)


#: Places of a model that travel as one row, so that a model is few rows wherever it goes.
BLOCK = 1 << 14
PART = "block int, places binary, weights binary"


def _sparse(stats: np.ndarray) -> pa.RecordBatch:
    """What a task has to add to a model: by block, the places within it (16 bits each) and their weights."""
    at = np.flatnonzero(stats > 1e-6)
    blocks, edges = np.unique(at // BLOCK, return_index=True)
    places, weights = (at % BLOCK).astype(np.uint16), stats[at]
    cut_at = [*edges.tolist(), len(at)]
    rows = [(places[a:z].tobytes(), weights[a:z].tobytes()) for a, z in zip(cut_at, cut_at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([p for p, _ in rows], pa.binary()), pa.array([w for _, w in rows], pa.binary())], ["block", "places", "weights"])


def _added(kind: str):
    """The sums of all rows of each block, as numbers of that kind; without places where the whole block is no longer."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                into = sums.setdefault(block, np.zeros(BLOCK))
                # a row has a place once
                into[np.frombuffer(b.column(1)[i].as_buffer(), np.uint16)] += np.frombuffer(b.column(2)[i].as_buffer(), np.float64)
        for block, x in sums.items():
            at = np.flatnonzero(x)
            x = x.astype(kind)
            few = len(at) * (2 + x.itemsize) < x.nbytes
            places, weights = (at.astype(np.uint16).tobytes(), x[at].tobytes()) if few else (None, x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([places], pa.binary()), pa.array([weights], pa.binary())], ["block", "places", "weights"])

    return go


def _flat(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a list column's lists, and their values one after the other."""
    return pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(a)


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens as they stand."""
    stats = np.zeros(SIZE)
    for b in batches:
        if b.num_rows:
            many, n = _flat(b.column(2))
            of = np.repeat(np.arange(b.num_rows), many)
            expected_counts([shape(t) for t in b.column(0).to_pylist()], np.bincount(of, n.to_numpy(), minlength=b.num_rows), stats)
    yield _sparse(stats)


class Block:
    """A batch of types with their candidates, flat; the first candidate of each is the token itself.

    Columns: token, sf list, n list, texts list (token first), shapes list, chains list (all candidates' one
    after the other), sizes list (how many chains each candidate has), odds list (what odd() says of each).
    """

    def __init__(self, b: pa.RecordBatch):
        self.batch = b
        many, sf = _flat(b.column(1))
        self.sf = sf.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = _flat(b.column(2))[1].to_numpy(zero_copy_only=False).astype(float)
        self.sf_owner = np.repeat(np.arange(b.num_rows), many)
        width, shapes = _flat(b.column(4))
        self.shapes = shapes.to_pylist()
        self.owner = np.repeat(np.arange(b.num_rows), width)
        self.identity = np.cumsum(width) - width
        self.flat = _flat(b.column(5))[1].to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = _flat(b.column(6))[1].to_numpy(zero_copy_only=False).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        control = [bool(_C1.search(t)) for t in b.column(0).to_pylist()]
        self.control = CONTROL * np.array(control, dtype=float)
        self.odd = _flat(b.column(7))[1].to_numpy(zero_copy_only=False).astype(float)

    def judge(self, counts: np.ndarray, prior: np.ndarray):
        """Log likelihoods; and pair, candidate and posterior of every candidate of every pair."""
        logs = likelihoods(self.shapes, counts) - self.odd
        logs[self.identity] -= self.control
        return logs, *posteriors(self.owner, logs, self.flat, self.of, self.sf_owner, self.sf, prior)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    return (Block(b) for b in batches if b.num_rows)


CANDIDATES = "token string, sf array<int>, n array<bigint>, texts array<string>, shapes array<string>, chains array<int>, sizes array<int>, odds array<float>"


def _candidates(model):
    """The types with the candidates that the first counts leave in the race."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _ = model.value
        for b in batches:
            if not b.num_rows:
                continue
            tokens = b.column(0).to_pylist()
            found = [list(repairs(t).items()) for t in tokens]
            texts = [v for t, c in zip(tokens, found) for v in (t, *(v for v, _ in c))]
            shapes = [shape(t) for t in texts]
            odds = [odd(v) for v in texts]
            logs = likelihoods(shapes, counts) - np.array(odds)
            width = np.array([len(c) + 1 for c in found])
            owner = np.repeat(np.arange(len(tokens)), width)
            best = np.full(len(tokens), -np.inf)
            np.maximum.at(best, owner, logs)
            keep = logs > best[owner] - TRAIL
            keep[np.cumsum(width) - width] = True
            out = [[], [], [], [], []]
            at = 0
            for c in found:
                kept = [k for k in range(len(c) + 1) if keep[at + k]]
                chains = [c[k - 1][1] if k else [IDENTITY] for k in kept]
                for column, x in zip(out, ([texts[at + k] for k in kept], [shapes[at + k] for k in kept], [x for cs in chains for x in cs], [len(cs) for cs in chains], [odds[at + k] for k in kept])):
                    column.append(x)
                at += len(c) + 1
            kinds = [pa.list_(pa.string())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x, t) for x, t in zip(out, kinds)]], ["token", "sf", "n", "texts", "shapes", "chains", "sizes", "odds"])

    return go


def _round(model):
    """Expected counts and chains under the model."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, prior = model.value
        stats = np.zeros(STATS)
        for x in _blocks(batches):
            _, pair, cand, post = x.judge(counts, prior)
            w = post * x.n[pair]
            mass = np.bincount(cand, w, minlength=len(x.shapes))
            some = np.flatnonzero(mass > 1e-3)
            expected_counts([x.shapes[i] for i in some], mass[some], stats[:SIZE])
            live = w > 1e-4
            pair, cand, w = pair[live], cand[live], w[live]
            # every chain of every live candidate, by its share of the candidate's prior
            many = x.sizes[cand]
            of = np.repeat(np.arange(len(cand)), many)
            start = (np.cumsum(x.sizes) - x.sizes)[cand]
            chain = x.flat[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            share = prior[x.sf[pair][of], chain]
            share = share / np.bincount(of, share, minlength=len(cand))[of] * w[of]
            stats += np.bincount(SIZE + x.sf[pair][of] * len(CHAINS) + chain, share, minlength=STATS)
        yield _sparse(stats)

    return go


def meaning(c: str) -> int:
    """A core of whatever length as a number, by which a line is searched for what an example stands for."""
    return int.from_bytes(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _verdicts(model):
    """Tokens that are likelier repaired, or lost, with the best repair for each source and field."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, prior = model.value
        names = ["token", "sf", "repaired", "meant", "letter", "chain", "p", "llr", "most", "kind"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        for x in _blocks(batches):
            logs, pair, cand, post = x.judge(counts, prior)
            tokens, texts = x.batch.column(0).to_pylist(), _flat(x.batch.column(3))[1].to_pylist()
            start = np.cumsum(x.sizes) - x.sizes
            is_id = np.isin(cand, x.identity)
            clean = np.zeros(len(x.sf))
            clean[pair[is_id]] = post[is_id]
            p, c, q = pair[~is_id], cand[~is_id], post[~is_id]
            order = np.lexsort((-q, p))
            p, c = p[order], c[order]
            firsts = np.flatnonzero(np.diff(p, prepend=-1))
            gain = logs - logs[x.identity[x.owner]]
            # no chain's log odds of a token are above that
            most = np.zeros(len(x.identity))
            np.maximum.at(most, x.owner, gain)
            # what turns letters into letters is weighed by lines, so it may be unlikely token by token
            firsts = firsts[(gain[c[firsts]] > 1) & ((1 - clean[p[firsts]] > 1e-4) | ~np.array([BY_FORM[x.flat[start[j] : start[j] + x.sizes[j]]].any() for j in c[firsts]], dtype=bool))]
            rows = []
            for k, j in zip(p[firsts], c[firsts]):
                chains = x.flat[start[j] : start[j] + x.sizes[j]]
                token, v = tokens[x.sf_owner[k]], texts[j]
                kind = "form" if BY_FORM[chains].any() or _C1.search(token) else "turn"
                top = chains[int(np.argmax(prior[x.sf[k], chains]))]
                c_v = core(v)
                rows.append((token, x.sf[k], v, None if token.startswith(BOMS) else meaning(c_v), c_v if len(c_v) == 1 else None, CHAINS[top], 1 - clean[k], gain[j], most[x.owner[j]], kind))
            for k, o in enumerate(x.sf_owner):
                if "�" in tokens[o]:
                    rows.append((tokens[o], x.sf[k], None, None, None, LOST, 1.0, 20.0, 0.0, LOST))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names)

    return go


def _gather(parts: DataFrame, size: int | None = None, kind: str = "float64") -> np.ndarray:
    """Sum of the parts of a model of `size` places, by default STATS: it comes to the driver as one row per block and as
    numbers of the kind that is kept, so that the driver has it twice at most, whatever the corpus."""
    size = STATS if size is None else size
    spark = parts.sparkSession
    t = parts.repartition(max(1, spark.sparkContext.defaultParallelism), "block").mapInArrow(_added(kind), PART).toArrow()
    stats = np.zeros(-(-size // BLOCK) * BLOCK, kind)
    for b in t.to_batches():
        for block, places, weights in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            at = np.frombuffer(places.as_buffer(), np.uint16) if places.is_valid else slice(None)
            stats[block * BLOCK : (block + 1) * BLOCK][at] += np.frombuffer(weights.as_buffer(), kind)
    b = places = weights = at = t = None
    pa.default_memory_pool().release_unused()
    return stats[:size]


@dataclass
class Garbled:
    """documents: (doc_id, score) of the altered ones; hits: where their tokens stand; verdicts: tokens with their repairs; turned: lines altered by chains without UTF-8, with repairs."""

    documents: DataFrame
    hits: DataFrame
    verdicts: DataFrame
    turned: DataFrame


def _spread(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table, read in splits of few types, for the work per byte is high."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return packed_read(df.sparkSession, path, target_bytes=SPLIT_BYTES, open_cost=64 << 10)


def learn(occ: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """EM over the token types of occ: the verdicts, in a table, and the model: counts, priors and how often words occur."""
    spark = occ.sparkSession
    sc = spark.sparkContext
    counted = occ.groupBy("token", "sf").agg(F.count(F.lit(1)).alias("n"))
    types = counted.groupBy("token").agg(F.collect_list(F.struct("sf", "n")).alias("x")).select("token", "x.sf", "x.n")
    types = _spread(types.repartition(max(1, sc.defaultParallelism), "token"), "types")
    counts = _gather(types.mapInArrow(_first_counts, PART))[:SIZE]
    prior = start_prior()
    model = sc.broadcast((counts, prior))
    cands = _spread(types.mapInArrow(_candidates(model), CANDIDATES), "candidates")
    for _ in range(rounds):
        stats = _gather(cands.mapInArrow(_round(model), PART))
        model.destroy()
        got = stats[SIZE:].reshape(SOURCE_BUCKETS * FIELDS, len(CHAINS))
        everywhere = got.sum(0) + 0.01
        everywhere /= everywhere.sum()
        # a source and field with few tokens leans on all the others
        prior = (got + 50 * everywhere) / (got.sum(1, keepdims=True) + 50)
        counts = stats[:SIZE]
        model = sc.broadcast((counts, prior))
    verdicts = cut(cands.mapInArrow(_verdicts(model), HITS), "verdicts")
    model.destroy()
    number = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")
    words = _gather(types.select("token", number).mapInArrow(_word_counts, PART), 2 * WORDS, "float32")
    return verdicts, (counts, prior, words)


_ENCODINGS = SINGLE + MULTI
#: Without those of two encodings of several bytes: their texts map one to one, character by character, so a model of
#: characters that has seen enough of either cannot tell which is meant.
_PAIRS = [(d, e) for d in _ENCODINGS for e in _ENCODINGS if d != e and (d in SINGLE or e in SINGLE)]


def word_places(v: str) -> tuple[int, int]:
    """Where a word, without marks and as the character model sees it, is counted."""
    h = xxhash.xxh64_intdigest(shape(core(v)).encode("utf-8", "surrogatepass"))
    return h & (WORDS - 1), WORDS + (h >> 32 & (WORDS - 1))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stats = np.zeros(2 * WORDS)
    for b in batches:
        if b.num_rows:
            places = np.array([word_places(t) for t in b.column(0).to_pylist()])
            np.add.at(stats, places.ravel(), np.repeat(b.column(1).to_numpy().astype(float), 2))
    yield _sparse(stats)


_PAIR_CHAIN = np.array([NUMBER[f"{d}>{e}"] for d, e in _PAIRS])
_PAIR_READ, _PAIR_MEANT = (np.array([_ENCODINGS.index(p[i]) for p in _PAIRS]) for i in (0, 1))
TURNED = "doc_id bigint, line int, place int, score double, n_turn bigint, repaired string"


class Weighed:
    """Tokens under every pair of encodings: text() is what a pair makes of one, odds its log odds.

    The altered form of a word is rarer than the word: where a token is frequent and its reading is not more so,
    the pair gains nothing by it. words are counts by hash in two rows, of which the smaller counts.

    A token that a pair leaves as it is has 0; one that the reading cannot have produced, or that the pair
    turns into what no text has, AGAINST. A token has few different byte strings, one for each way in which
    it can have been read, so these are decoded and weighed and not the pairs.
    """

    def __init__(self, tokens: list[str], counts: np.ndarray, words: np.ndarray):
        self.raws: list[list[bytes]] = []
        self.odds = np.full((len(tokens), len(_PAIRS)), AGAINST)
        self.read = np.full((len(tokens), len(_ENCODINGS)), -1)
        shapes, odds, often, joints, at = [], [], [], [], {}

        def number(v: str) -> int:
            if v not in at:
                at[v] = len(shapes)
                shapes.append(shape(v))
                odds.append(odd(v))
                a, b = word_places(v)
                often.append(min(words[a], words[b]))
                joints.append(_joints(v))
            return at[v]

        rows = []
        for i, t in enumerate(tokens):
            raws: dict[bytes, int] = {}
            forms = [number(t)]
            for d, name in enumerate(SINGLE):
                v = _utf8(t, name)
                if v:
                    forms.append(number(v))
                try:
                    self.read[i, d] = raws.setdefault(codecs.charmap_encode(t, "strict", MAP[name])[0], len(raws))
                except UnicodeEncodeError:
                    pass
            wide = max(t) >= "\u3000"
            if wide:
                for d, name in enumerate(MULTI, len(SINGLE)):
                    try:
                        self.read[i, d] = raws.setdefault(t.encode(name), len(raws))
                    except UnicodeEncodeError:
                        pass
            self.raws.append(list(raws))
            texts = np.full((len(raws), len(_ENCODINGS)), -1)
            for r, raw in enumerate(raws):
                for e, name in enumerate(_ENCODINGS):
                    v = self._meant(raw, name)
                    # a soft hyphen, which is not seen, is no half of a wide character's bytes
                    if v and (v == t or not _C1.search(v)) and not (wide and name in TABLE and "\xad" in v):
                        texts[r, e] = number(v)
            rows.append((forms, texts, bool(_C1.search(t))))
        logs = likelihoods(shapes, counts) - np.array(odds) if shapes else np.zeros(0)
        often, joints = np.array(often), np.array(joints)
        for i, (forms, texts, control) in enumerate(rows):
            if not len(texts):
                continue
            # where UTF-8 shows by its form, the pair has to beat that too
            base = max([logs[forms[0]] - CONTROL * control, *(logs[v] for v in forms[1:])])
            value = np.where(texts < 0, AGAINST, np.maximum(AGAINST, logs[texts] - base))
            n = often[forms[0]]
            # to fall apart into words speaks for no reading
            nothing = (joints[texts] > joints[forms[0]]) | ((often[texts] <= n) & (n >= OFTEN))
            value = np.where((texts >= 0) & nothing, np.minimum(value, 0), value)
            value[texts == forms[0]] = 0.0
            of = self.read[i][_PAIR_READ]
            self.odds[i] = np.where(of < 0, AGAINST, value[of, _PAIR_MEANT])

    @staticmethod
    def _meant(raw: bytes, name: str) -> str | None:
        if name in TABLE:
            return codecs.charmap_decode(raw, "strict", TABLE[name])[0]
        return _multi(raw, name) if len(raw) > 1 else None

    def text(self, i: int, k: int) -> str | None:
        r = self.read[i, _PAIR_READ[k]]
        return None if r < 0 else self._meant(self.raws[i][r], _ENCODINGS[_PAIR_MEANT[k]])


def least_needed(prior: np.ndarray) -> float:
    """Log odds that a document's tokens must give together before any pair of encodings can be likelier than none."""
    known = np.log(prior[:, _PAIR_CHAIN]).max() - np.log(prior[:, IDENTITY]).min()
    return -min(KNOWN, max(UNKNOWN, float(known)))


def best_pieces(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every line and column the greatest sum of a run of rows, less the log of the number of runs, and the run's ends.

    odds: lines, rows, columns. Rows of 0 are left as they are by the column's chain: they neither count for
    nor against it, so lines may be filled up with them.
    """
    lines, n, width = odds.shape
    best, run, begin = np.zeros((lines, width)), np.zeros((lines, width)), np.zeros((lines, width), dtype=np.int32)
    lo, hi = np.zeros((lines, width), dtype=np.int32), np.full((lines, width), -1, dtype=np.int32)
    for i in range(n):
        begin = np.where(run > 0, begin, i)
        run = np.maximum(run, 0) + odds[:, i]
        better = run > best
        best, lo, hi = np.where(better, run, best), np.where(better, begin, lo), np.where(better, i, hi)
    many = np.maximum(1, (odds != 0).sum(1))
    return best - np.log(many * (many + 1) / 2), lo, hi


#: Rows of lines that are gone through together.
TOGETHER = 4096


def _pieces(lines: list[tuple[np.ndarray, np.ndarray]], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_pieces of lines, given by their tokens and by which of these came before in the document; such a token may only speak against."""
    shape_ = (len(lines), odds.shape[1])
    value, lo, hi = np.zeros(shape_), np.zeros(shape_, dtype=np.int32), np.zeros(shape_, dtype=np.int32)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i][0]))
    at = 0
    while at < len(order):
        # lines of nearly one length, filled up to the longest
        end = at + 1
        while end < len(order) and (end - at + 1) * len(lines[order[end]][0]) <= TOGETHER:
            end += 1
        some = order[at:end]
        m = np.zeros((len(some), len(lines[some[-1]][0]), odds.shape[1]))
        for r, i in enumerate(some):
            tokens, again = lines[i]
            rows = odds[tokens]
            rows[again] = np.minimum(rows[again], 0)
            m[r, : len(tokens)] = rows
        value[some], lo[some], hi[some] = best_pieces(m)
        at = end
    return value, lo, hi


def _turned(model):
    """The lines of documents that are likelier altered by one pair of encodings, with the repairs.

    The log odds of a line's best piece are summed by pair over the document, in which a token counts once.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, prior, words = model.value
        names = ["doc_id", "line", "place", "score", "n_turn", "repaired"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.string()]
        for b in batches:
            docs = b.column(1).to_pylist()
            tokens = sorted({x["token"] for xs in docs for x in xs if "\ufffd" not in x["token"]})
            weighed = Weighed(tokens, counts, words)
            odds = weighed.odds
            number = {t: i for i, t in enumerate(tokens)}
            # the lines of all documents, with the document of each
            lines, numbers, places, of, fields = [], [], [], [], []
            for n, xs in enumerate(docs):
                by: dict[int, list] = {}
                seen: set[int] = set()
                for x in sorted(xs, key=lambda x: (x["line"], x["place"])):
                    if x["token"] in number:
                        by.setdefault(x["line"], []).append((number[x["token"]], x["place"]))
                fields.append(sorted({x["sf"] for x in xs if x["token"] in number}))
                for l, ts in by.items():
                    again = [t in seen or seen.add(t) is not None for t, _ in ts]
                    lines.append((np.array([t for t, _ in ts]), np.array(again)))
                    numbers.append(l)
                    places.append([at for _, at in ts])
                    of.append(n)
            if not lines:
                continue
            value, lo, hi = _pieces(lines, odds)
            total = np.zeros((len(docs), len(_PAIRS)))
            np.add.at(total, of, np.maximum(value, 0))
            chains, scores, rows = {}, {}, []
            for n in sorted(set(of)):
                known = np.log(prior[fields[n]][:, _PAIR_CHAIN]).max(0) - np.log(prior[fields[n], IDENTITY]).max()
                log_odds = total[n] + np.clip(known, UNKNOWN, KNOWN)
                k = int(np.argmax(log_odds))
                if log_odds[k] >= 0:
                    chains[n], scores[n] = k, float(1 / (1 + np.exp(-log_odds[k])))
            ids = b.column(0).to_pylist()
            for r, n in enumerate(of):
                if n not in chains:
                    continue
                k = chains[n]
                ts = list(zip(lines[r][0].tolist(), places[r]))
                if value[r, k] > 0:
                    put = [(t, at) for t, at in ts[lo[r, k] : hi[r, k] + 1] if odds[t, k] != 0]
                else:
                    put = [(t, at) for t, at in ts if odds[t, k] > 0] if all(odds[t, k] >= 0 for t, _ in ts) else []
                for t, at in put:
                    rows.append((ids[n], numbers[r], at, scores[n], len(put), weighed.text(t, k)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names)

    return go


def _scores(hits: DataFrame, turned: DataFrame) -> DataFrame:
    """(doc_id, score, lines, most): the evidence of a document's hits, and of its lines in turned.

    Tokens that show UTF-8 by their form count alone or, when weak, together. Tokens that may be
    another encoding's letters count by document and chain: see _turned.
    """
    odds = lambda x: 1 / (1 + F.exp(-x))
    form, lost = (F.col("kind") == k for k in ("form", LOST))
    by_line = hits.groupBy("doc_id", "line").agg(
        F.sum(F.when(form, F.col("llr")).otherwise(0)).alias("form"),
        F.max(F.when(form | lost, F.col("p")).otherwise(0)).alias("p"),
        F.count(F.when(form, 1)).alias("n_form"),
        F.count(F.when((form | lost) & (F.col("p") >= 0.02), 1)).alias("clear"),
    )
    by_turn = turned.groupBy("doc_id", "line").agg(F.max("score").alias("turned"), F.max("n_turn").alias("n_turn"))
    lines = by_line.join(by_turn, ["doc_id", "line"], "full").fillna(0)
    hot = F.when(F.col("turned") >= 0.5, F.greatest("clear", "n_turn")).otherwise(F.col("clear"))
    docs = lines.groupBy("doc_id").agg(
        F.max(F.greatest("p", "turned")).alias("one"),
        F.sum("form").alias("form"),
        F.sum("n_form").alias("n_form"),
        F.count(F.when(hot > 0, 1)).alias("lines"),
        F.max(hot).alias("most"),
    )
    together = F.when(F.col("n_form") > 0, odds(F.col("form") - 5)).otherwise(0.0)
    return docs.select("doc_id", F.greatest("one", together).alias("score"), "lines", "most")


def _quoted(hits: DataFrame, context: DataFrame, occ: DataFrame) -> DataFrame:
    """(doc_id, line, place) of hits that are examples: a page that speaks of such characters.

    An example names what it stands for in the same line (a byte order mark is none); or it is one character alone between words
    between which that character never stands elsewhere, and either different characters are quoted
    between the same words, or it is a letter that is no word beside either of them, or it is lost between
    ordinary words beside neither of which any letter is a word. Copies of a page are no evidence.

    context has the tokens of the hits' documents, of whatever length; occ those of all documents, with the
    neighbours of single characters.
    """
    at = ["doc_id", "line", "place"]
    # the documents that are in question are few; what is derived from them is kept as tables
    hits = cut(hits.where(F.col("kind") != "turn").join(context, at), "quoted-hits")
    one = hits.where(F.col("letter").isNotNull() | (F.col("kind") == LOST))
    there = context.select("doc_id", "line", meaning_of("core").alias("meant")).distinct()
    pairs = hits.join(there, ["doc_id", "line", "meant"], "left_semi").select(*at)
    places = cut(one.groupBy("prev", "next").agg(F.countDistinct("letter").alias("kinds")), "places")
    alone = occ.where(F.col("core").isNotNull() & (F.col("core") != "\ufffd")).groupBy("prev", "next", "core").agg(F.min("doc_id").alias("doc_id"))
    alone = cut(alone, "alone")
    seen = cut(lookup_join(alone, places.drop("kinds"), ["prev", "next"], "left_semi", spread=F.col("doc_id")).select("prev", "next", "core").distinct(), "seen")
    letter = F.col("core").rlike(r"^\p{L}$")
    exact = seen.withColumnRenamed("core", "letter")
    marks = seen.where(~letter).select("prev", "next").distinct()
    lone = one.where(F.col("kind") != LOST).join(exact, ["prev", "next", "letter"], "left_anti").select(*one.columns)
    gone = one.where(F.col("kind") == LOST).join(marks, ["prev", "next"], "left_anti").select(*one.columns)
    plain = F.col("prev").rlike("^[a-z]+$") & F.col("next").rlike("^[a-z]+$")
    unseen = cut(lone.unionByName(gone).join(places, ["prev", "next"]), "unseen")
    # letters that are words beside one of the neighbours, as a-grave is in French
    for side in ("prev", "next"):
        words = lookup_join(alone.where(letter).select(side, "core", "doc_id"), unseen.select(side).distinct(), [side], "left_semi", spread=F.col("doc_id"))
        unseen = unseen.join(words.groupBy(side).agg(F.collect_set("core").alias(f"words_{side}")), side, "left")
    words = F.concat(*(F.coalesce(f"words_{side}", F.array().cast("array<string>")) for side in ("prev", "next")))
    stray = F.coalesce(F.col("letter").rlike(r"^\p{L}$") & ~F.array_contains(words, F.col("letter")), F.lit(False))
    example = unseen.where((F.col("kinds") > 1) | stray | ((F.col("kind") == LOST) & plain & (F.col("core") == "\ufffd") & (F.size(words) == 0)))
    return pairs.unionByName(example.select(*at)).distinct()


def meaning_of(col: str):
    """meaning() of a column."""

    @F.arrow_udf("bigint")
    def hashed(a: pa.Array) -> pa.Array:
        return pa.array([None if c is None else meaning(c) for c in a.to_pylist()], pa.int64())

    return hashed(F.col(col))


def find_garbled(docs: DataFrame, rounds: int = ROUNDS) -> Garbled:
    """The documents (doc_id, text, source) whose text is altered by wrong decoding, in whole or part.

    Null, empty and ASCII texts are never altered. Characters lost to U+FFFD count, quoted examples
    do not. A repeated doc_id counts as one document. All rows and whole texts are read; the
    corpus' tokens are aggregated before they are shuffled, and the model that goes to the driver has
    a fixed size. An empty table gives no rows.
    """
    occ = cut(docs.select("doc_id", "source", "text").mapInArrow(_find_occurrences, OCC), "occurrences")
    verdicts, arrays = learn(occ, rounds)
    # narrow rows of a fixed width, so that a bound on their number is one on their size
    keyed = verdicts.select(F.xxhash64("token").alias("h"), "sf", "p", "llr", "most", "kind", "meant", "letter")
    named = occ.withColumn("h", F.xxhash64("token")).select("doc_id", "line", "place", "sf", "h")
    hits = cut(lookup_join(named, keyed, ["h", "sf"], "inner", spread=F.xxhash64("doc_id", "line")), "hits")
    # documents whose tokens, each once, can give what a pair of encodings needs; in the others none can be likelier than none
    gains = hits.where(F.col("kind") != LOST).groupBy("doc_id", "h").agg(F.max("most").alias("most"))
    able = gains.groupBy("doc_id").agg(F.sum("most").alias("most")).where(F.col("most") >= least_needed(arrays[1])).select("doc_id")
    model = docs.sparkSession.sparkContext.broadcast(arrays)
    # from here on the workers alone need it
    del arrays
    suspects = cut(hits.where(F.col("kind") == "turn").select("doc_id", "line").distinct().join(able, "doc_id", "left_semi"), "suspects")
    # a document's suspect lines: never more than its own text
    near = lookup_join(occ.select("doc_id", "line", "sf", "place", "token"), suspects, ["doc_id", "line"], "left_semi", spread=F.xxhash64("doc_id", "line"))
    whole = near.groupBy("doc_id").agg(F.collect_set(F.struct("line", "place", "sf", "token")).alias("x"))
    turned = cut(whole.mapInArrow(_turned(model), TURNED), "turned")
    model.destroy()
    scores = cut(_scores(hits, turned).where(F.col("score") >= 0.5), "scores")
    # a few clear tokens in one or two lines may be examples; more than that is no example
    open_docs = scores.where((F.col("lines") <= 2) & (F.col("most") <= 2)).select("doc_id")
    open_hits = cut(hits.join(open_docs, "doc_id", "left_semi"), "open")
    clear = open_hits.where(F.col("p") >= 0.02)
    texts = lookup_join(docs.select("doc_id", "text"), open_docs, ["doc_id"], "left_semi", spread=F.xxhash64("text"))
    # repeated ids are one document
    context = cut(texts.mapInArrow(_contexts, CONTEXT).distinct(), "context")
    quotes = cut(_quoted(clear, context, occ), "quotes")
    at = ["doc_id", "line", "place"]
    rest = open_hits.join(quotes, at, "left_anti")
    sure = scores.join(open_docs, "doc_id", "left_anti").select("doc_id", "score")
    checked = _scores(rest, turned.join(open_docs, "doc_id", "left_semi")).where(F.col("score") >= 0.5).select("doc_id", "score")
    found = cut(sure.unionByName(checked), "garbled")
    real = lookup_join(hits, quotes, at, "left_anti", spread=F.col("h")).join(found.select("doc_id"), "doc_id", "left_semi")
    return Garbled(found, real, verdicts, turned)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, pairs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            to: dict[int, dict[int, str]] = {}
            for p in pairs or []:
                to.setdefault(p["line"], {})[p["place"]] = p["repaired"]
            lines = text.split("\n") if to else []
            for i, new in to.items():
                if i < len(lines):
                    spans = list(tokens_of(lines[i]))
                    for n in sorted((n for n in new if n < len(spans)), reverse=True):
                        a, z = spans[n]
                        lines[i] = lines[i][:a] + new[n] + lines[i][z:]
            texts.append("\n".join(lines) if to else text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def repaired(docs: DataFrame, g: Garbled) -> DataFrame:
    """(doc_id, text) of the altered documents, each token replaced, in its place, by its likeliest meaning.

    Tokens with a posterior below one half stay as they are, but for those that show UTF-8 by their form;
    of a token that is lost in part the rest is repaired. A token that is quoted as an example stays,
    also where the same token is damage in another line. The places of one document are gathered
    beside its text, of which they are a part.
    """
    likely = (F.col("p") >= 0.5) | ((F.col("kind") == "form") & (F.col("llr") >= 2))
    at = ["doc_id", "line", "place"]
    sure = g.hits.where(likely & (F.col("kind") != LOST)).select(*at, "h", "sf").distinct()
    by = g.verdicts.where(F.col("repaired").isNotNull()).select(F.xxhash64("token").alias("h"), "sf", "repaired")
    told = sure.join(by, ["h", "sf"]).select(*at, "repaired")
    # the chain of a whole line goes before the likeliest one of a token alone
    chained = g.turned.where(F.col("repaired").isNotNull()).select(*at, "repaired").distinct()
    told = told.join(chained, at, "left_anti").unionByName(chained)
    each = told.groupBy("doc_id").agg(F.collect_set(F.struct("line", "place", "repaired")).alias("pairs"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(g.documents.select("doc_id"), "doc_id", "left_semi")
    return texts.join(each, "doc_id", "left").select("doc_id", "text", "pairs").mapInArrow(_replace, "doc_id bigint, text string")
