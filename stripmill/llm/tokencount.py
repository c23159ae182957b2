"""Token counts from a tokenizer that is compiled into finite-state transducers; no token is ever written.

Two deterministic machines stand for a BPE vocabulary with word ends:

* The word machine reads classes of characters and marks where words begin. It has seven states, so all its maps from
  states to states form a small monoid, which is compiled with it. A batch of texts is cut into chunks of CHUNK
  characters; within all chunks at once, maps of prefixes are composed step by step; the chunks' own maps are then composed by a
  parallel prefix scan, which tells each chunk the state it is entered in, and with it the state before each character.
* The token machine reads the bytes of a word, the last one marked, and annotates each transition with the tokens that
  it emits: the change in the number of tokens of what has been read, which may be negative, as a longer token
  can take the place of several. Of a prefix it need know only the last token at those places where a token that still goes on
  may have begun: the last token of a longer prefix is the one token that ends there and forms a valid pair with the last token before it, a pair
  being valid if merging never joins across its border. States are made when first reached. Above STATES of them
  the table is begun anew, which changes no result.

Words are independent, so all words of a batch run at once, step by step, and counts add up by document.

Classes and lower case of a character are asked of the tokenizer's library, once for each that occurs. Texts that aren't in
normal form C, or hold a character whose lower case is several, are normalised by the library.

Defined cases: a null text counts as empty, an empty one has no tokens; special strings inside a text count as one token
each, as by the library's default; texts of any length are worked on in pieces that end with white space; rows are
independent, so ties, repeated rows and null ids are no special case; an empty table gives an empty result; columns that are
asked for pass through, and the new ones take other names if theirs are taken.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stripmill.llm.common import fresh, small_batches

VOCABULARY = "word_bpe_49k.json"
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: Characters of a chunk, and of a piece of text that is worked on at once.
CHUNK, PIECE = 256, 1 << 20
#: States of the token machine's table before it is begun anew.
STATES = 1 << 18

# The one normalisation and splitting that the word machine stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, DIGIT, OTHER, QUOTE, S, R, V, L, E = CLASSES = range(10)
#: Characters with a class of their own: the quote that may begin a contraction, and its letters.
_OWN = {"'": QUOTE, "s": S, "t": S, "m": S, "d": S, "r": R, "v": V, "l": L, "e": E}
#: States of the word machine: between words, in letters, in other signs, after a quote that begins a word, and after that and a
#: letter that may go on to a contraction.
BETWEEN, LETTERS, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = WORD_STATES = range(7)
#: What a transition emits: a word begins at this character; one began at the character before.
HERE, BEFORE = 1, 2


def _word_step(state: int, c: int) -> tuple[int, int]:
    """Next state and emission of the word machine."""
    if (state, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L), (QUOTED, S)):
        return BETWEEN, 0
    if state == QUOTED and c in (R, V, L):
        return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        to, said = _word_step(LETTERS, c)
        return to, said | BEFORE
    if c == SPACE:
        return BETWEEN, 0
    if c == DIGIT:
        return BETWEEN, HERE
    if c in (OTHER, QUOTE):
        if state in (SIGNS, QUOTED):
            return SIGNS, 0
        return (QUOTED if c == QUOTE else SIGNS), HERE
    return LETTERS, 0 if state == LETTERS else HERE


def _word_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """emitted[state, class]; maps[m, state]: all maps that sequences of classes make, the first being the identity;
    single[class]: the map of one character; composed[m, n]: the map of m, then n."""
    step = np.array([[_word_step(s, c) for c in CLASSES] for s in WORD_STATES])
    of_class = [tuple(step[:, c, 0].tolist()) for c in CLASSES]
    found = {tuple(WORD_STATES): 0}
    todo = [tuple(WORD_STATES)]
    for m in todo:
        for g in of_class:
            n = tuple(g[s] for s in m)
            if n not in found:
                found[n] = len(found)
                todo.append(n)
    composed = [[found[tuple(n[s] for s in m)] for n in todo] for m in todo]
    return step[:, :, 1].astype(np.uint8), np.array(todo, np.uint8), np.array([found[g] for g in of_class], np.uint8), np.array(composed, np.uint8)


EMITTED, MAPS, SINGLE, COMPOSED = _word_machine()


def scanned(maps: np.ndarray) -> np.ndarray:
    """Compositions of each map with all before it, in a number of steps that is the logarithm of their number."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = COMPOSED[out[:-reach], out[reach:]]
        reach *= 2
    return out


def word_marks(classes: np.ndarray) -> np.ndarray:
    """Emissions of the word machine at every character; it is between words before the first one."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, SPACE, np.uint8)
    padded[:n] = classes
    # steps are rows, so that each reads memory in order
    own = np.ascontiguousarray(SINGLE[padded].reshape(chunks, CHUNK).T)
    before = np.zeros_like(own)
    for t in range(1, CHUNK):
        before[t] = COMPOSED[before[t - 1], own[t - 1]]
    whole = COMPOSED[before[-1], own[-1]] if chunks else np.zeros(0, np.uint8)
    entered = np.r_[np.uint8(0), scanned(whole)[:-1]] if chunks else whole
    state = MAPS[before, MAPS[entered, BETWEEN][None, :]]
    return EMITTED[state.T.reshape(-1)[:n], classes]


class Vocabulary:
    """Tokens and merges of a BPE vocabulary over bytes, of which the last of a word is marked: symbol 256 + byte."""

    def __init__(self, model: dict):
        ends = model["end_of_word_suffix"]
        if not ends or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("a vocabulary of bytes with word ends, merged in order of rank, is needed")
        of_sign = {sign: byte for byte, sign in enumerate(byte_signs())}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        vocabulary = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = vocabulary[left + right]
            a, b = vocabulary[left], vocabulary[right]
            if made in self.born or self.born.get(a, -1) >= rank or self.born.get(b, -1) >= rank:
                raise ValueError("merges must make each token once, after its parts")
            self.rank[a, b], self.parts[made], self.born[made] = rank, (a, b), rank
        #: child of (node, symbol), at node * 512 + symbol; node 0 is the root
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner: set[int] = set()
        nodes = 1
        for text, token in vocabulary.items():
            last = text.endswith(ends)
            symbols = [of_sign[c] for c in (text.removesuffix(ends) if last else text)]
            if last:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                self.inner.add(node)
                if (to := self.child.get(node * 512 + s)) is None:
                    to = self.child[node * 512 + s] = nodes
                    nodes += 1
                node = to
            self.token[node] = token
        self._valid: dict[tuple[int, int], bool] = {}

    def valid(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together gives a, then b: no merge joins what stands at their border
        before both are complete.

        Goes back in time: of the two symbols at the border the one made later is undone, until neither is made of others. Two that
        stand there at one time would be joined by a merge of lower rank than those that take them up; of merges of one
        rank the left one comes first."""
        known = self._valid.get((a, b))
        if known is None:
            x, y, x_until, y_until, known = a, b, _NEVER, _NEVER, True
            while True:
                rank = self.rank.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    known = False
                    break
                x_born, y_born = self.born.get(x, -1), self.born.get(y, -1)
                if x_born < 0 and y_born < 0:
                    break
                if x_born >= y_born:
                    x, x_until = self.parts[x][1], x_born
                else:
                    y, y_until = self.parts[y][0], y_born
            self._valid[a, b] = known
        return known


_NEVER = 1 << 60


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in vocabularies over bytes: the byte's own Latin-1 sign if it is
    visible, else one from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class TokenMachine:
    """The token machine, made as it is used. A state is a tuple, for every place where a token that still goes on may have
    begun, of its node, the last token before it, and the number of tokens there less that here.

    Transitions stand in a hash table of arrays: in `keys` state * 512 + symbol, in `to` the next state and in `emitted` the tokens."""

    #: Before the first byte of a word.
    START = (0, -1, 0)

    def __init__(self, vocabulary: Vocabulary, states: int = STATES):
        self.vocabulary, self.most = vocabulary, states
        self.begin()

    def begin(self) -> None:
        self.number = {self.START: 0}
        self.states = [self.START]
        self.made = 0
        self._room(1 << 16)

    def _room(self, slots: int) -> None:
        self.keys, self.to, self.emitted = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int8)
        self.shift = np.uint64(64 - slots.bit_length() + 1)

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The next state and the tokens emitted; after a word's last byte the state is the first one."""
        v, on, token, emitted = self.vocabulary, [], -1, 0
        for k in range(0, len(state), 3):
            to = v.child.get(state[k] * 512 + symbol)
            if to is None:
                continue
            if token < 0 and (whole := v.token.get(to)) is not None and (state[k + 1] < 0 or v.valid(state[k + 1], whole)):
                token, emitted = whole, state[k + 2] + 1
            if to in v.inner:
                on.append((to, state[k + 1], state[k + 2]))
        if symbol >= 256:
            return self.START, emitted
        return tuple([x for to, last, less in on for x in (to, last, less - emitted)] + [0, token, 0]), emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where it belongs."""
        with np.errstate(over="ignore"):
            slot = ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)
        rest = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            rest = rest[(self.keys[slot[rest]] != keys[rest]) & (self.keys[slot[rest]] >= 0)]
        return slot

    def _compile(self, keys: np.ndarray) -> None:
        keys = np.unique(keys)
        if 3 * (self.made + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.to[held], self.emitted[held]
            self._room(max(2 * len(self.keys), 1 << (4 * (self.made + len(keys))).bit_length()))
            self._put(*old)
        to, emitted = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int8)
        for k, key in enumerate(keys.tolist()):
            state, emitted[k] = self.step(self.states[key >> 9], key & 511)
            n = to[k] = self.number.setdefault(state, len(self.states))
            if n == len(self.states):
                self.states.append(state)
        self._put(keys, to, emitted)
        self.made += len(keys)

    def _put(self, keys: np.ndarray, to: np.ndarray, emitted: np.ndarray) -> None:
        """Puts in keys that aren't there; of those that want one slot each time one gets it."""
        while len(keys):
            slot = self._slots(keys)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.to[slot[first]], self.emitted[slot[first]] = keys[first], to[first], emitted[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, emitted = keys[rest], to[rest], emitted[rest]

    def counts(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word, given by its place and length in symbols."""
        if len(self.states) > self.most:
            self.begin()
        longest = length.max(initial=0)
        order = np.argsort(-length.astype(np.int16) if longest < 1 << 15 else -length, kind="stable")
        start, length = begin[order], length[order]
        running = len(length) - np.searchsorted(length[::-1], np.arange(1, longest + 1))
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t, n in enumerate(running.tolist()):
            keys = state[:n] * 512 + symbols[start[:n] + t]
            slot = self._slots(keys)
            missing = self.keys[slot] < 0
            if missing.any():
                self._compile(keys[missing])
                slot = self._slots(keys)
            total[:n] += self.emitted[slot]
            state[:n] = self.to[slot]
        out = np.empty_like(total)
        out[order] = total
        return out


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Counter:
    """A compiled tokenizer."""

    def __init__(self, source: str):
        spec = json.loads(source)
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if spec["normalizer"] != NORMALIZER or [x["type"] for x in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"] != {"Regex": SPLITTER} or not splits[0]["invert"] or splits[0]["behavior"] != "Removed" or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
            raise ValueError("the word machine stands for another normalisation or splitting")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings must match as they are")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.marks = {t[0] for t in special}
        self.library = Tokenizer.from_str(source)
        self.machine = TokenMachine(Vocabulary(spec["model"]))
        # of each code point: its lower case, -1 unknown and -2 several; and the class of what it is in lower case
        self.lower, self.kind = np.full(0x110000, -1, np.int32), np.full(0x110000, 255, np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            low = self.library.normalizer.normalize_str(chr(p))
            # what the library composes or decomposes alone is no matter here: such texts aren't in normal form
            self.lower[p] = ord(low) if len(low) == 1 else -2
            self.kind[p] = self._class(low if len(low) == 1 else chr(p))

    def _class(self, c: str) -> int:
        if c in _OWN:
            return _OWN[c]
        pieces = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        if not pieces(c):
            return SPACE
        return LETTER if pieces("a" + c) == 1 else DIGIT if pieces(c + c) == 2 else OTHER

    def points(self, text: str) -> np.ndarray:
        """Code points of the normalised text."""
        if not unicodedata.is_normalized("NFC", text):
            return np.frombuffer(self.library.normalizer.normalize_str(text).encode("utf-32-le"), np.uint32)
        found = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = self.lower[found]
        if low.min(initial=0) < 0:
            self._learn(np.unique(found[low == -1]))
            low = self.lower[found]
            if low.min(initial=0) < 0:
                return np.frombuffer(self.library.normalizer.normalize_str(text).encode("utf-32-le"), np.uint32)
        return low.astype(np.uint32)

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of PIECE characters or more that end with white space, if it has any there."""
        at = 0
        while len(text) - at > PIECE:
            space = _SPACE.search(text, at + PIECE)
            end = space.end() if space else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(m in text for m in self.marks):
                text, n = self.special.subn(" ", text)
                total[k] += n
            for piece in self._pieces(text):
                held.append(self.points(piece))
                owners.append(k)
                size += len(held[-1])
                if size > PIECE:
                    self._add(held, owners, total)
                    held, owners, size = [], [], 0
        if held:
            self._add(held, owners, total)
        return total

    def _add(self, held: list[np.ndarray], owners: list[int], total: np.ndarray) -> None:
        # a space after each piece keeps its words apart from the next one's
        points = np.concatenate([x for piece in held for x in (piece, np.array([32], np.uint32))])
        unknown = self.kind[points] == 255
        if unknown.any():
            self._learn(np.unique(points[unknown]))
        kind = self.kind[points]
        said = word_marks(kind)
        begins = (said & HERE) > 0
        begins[:-1] |= (said[1:] & BEFORE) > 0
        inside = kind != SPACE
        last = inside.copy()
        last[:-1] &= begins[1:] | ~inside[1:]
        data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        after = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        symbols = data.astype(np.int16)
        symbols[after[last] - 1] += 256
        first = np.flatnonzero(begins)
        begin = np.where(first > 0, after[first - 1], 0)
        counts = self.machine.counts(symbols, begin, after[last] - begin)
        ends = np.cumsum([len(piece) + 1 for piece in held])
        owner = np.array(owners)[np.searchsorted(ends, first, side="right")]
        np.add.at(total, owner, counts)


_SPACE = re.compile(r"[ \t\n\r]")
_compiled: dict[int, Counter] = {}


def compiled(source: str) -> Counter:
    """The counter, once for each worker."""
    key = hash(source)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Counter(source)
    return _compiled[key]


def _counting(source, text: str, keep: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(source.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            n_tokens = pa.array(counter.counts(column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], n_bytes, n_tokens], names=[*keep, *names])

    return run


def counted(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns `keep` of docs, with n_bytes (UTF-8) and n_tokens of the text by the vocabulary at `path`."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary's file
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    names, given = [fresh(rows, "n_bytes"), fresh(rows, "n_tokens")], fresh(rows, "text_")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(given))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != given], *[T.StructField(n, T.LongType()) for n in names]])
    return rows.mapInArrow(_counting(source, given, keep, names), schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return counted(docs, ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
