"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

1. The token automaton. Its arcs carry tokens; its paths from the start are the correct token sequences and no others.
   It begins with one state per byte and an arc for every byte, and each merge (a, b) -> c adds a gadget to it: the arc
   from a on b goes; a state for c takes over b's arcs as they are then; every state with an arc on a gets one on c.
   (For a = b the state a gets none on c: three a's are c a, never a c.) What was taken over is kept as links to what
   it was copied from, with the merge's number, so the tables grow with the vocabulary alone.
2. The byte automaton. Each arc on a token is spelled out into arcs on its bytes (through one trie of all labels), and
   the result is made deterministic by the subset construction: a state is the set of pairs (token state, node of the
   trie) that its bytes lead to. Since a text has one correct token sequence, each state has exactly one pair that
   stands at the end of a token, and that token is the state's output. Transitions, (state, byte) -> state, are
   compiled when they are first taken and kept in a table; past MOST_STATES states the table starts anew, as all of
   it can be compiled again.

A pre-split word is encoded by one table look-up a byte. The outputs of the states on its way are the last tokens of
its beginnings; read from the end, each tells where the one before it ends. There is no search and no way back.
Words are split at class changes of code points in numpy.

Edge cases: null and empty texts have no tokens; a word of any length is encoded whole, in linear time; strings of
special tokens in a text become those tokens unless encode_special is false; decoding is exact for valid UTF-8;
columns of the same names as the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossmill.llm import runtime

#: States of a compiled byte automaton, and words whose tokens a task keeps; past it the table starts anew.
MOST_STATES, CACHE_WORDS = 120_000, 150_000
#: Longer words are not kept.
CACHE_LENGTH = 64
#: Code points of a text that are split into words at a time.
SPLIT = 1 << 18

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: The contractions of the byte-level pre-tokenizer, and the code points of White_Space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
NEVER = 1 << 30


def code_point_classes(tokenizer: str | None = None) -> np.ndarray:
    """Letter, number, white space or other, for each code point, as the pre-tokenizer's pattern has them.

    Code points that Python's own Unicode tables don't have yet are put to the pre-tokenizer of the tokenizer file,
    whose content is given.
    """
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    fresh = np.zeros(0x110000, bool)
    for i in range(0x110000):
        category = unicodedata.category(chr(i))
        table[i] = kinds.get(category[0], OTHER)
        if category == "Cn" and i % 0x10000 < 0xFFFE:
            fresh[i] = True
    table[list(WHITE_SPACE)] = BLANK
    if tokenizer is not None:
        import regex
        from tokenizers import Tokenizer

        data = json.loads(tokenizer)
        data["model"] |= {"vocab": {}, "merges": []}  # the pre-tokenizer alone is asked
        data |= {"added_tokens": [], "post_processor": None, "decoder": None}
        split = Tokenizer.from_str(json.dumps(data)).pre_tokenizer
        newer = regex.compile(r"[\p{L}\p{N}]")
        for i in np.flatnonzero(fresh).tolist():
            if newer.match(chr(i)):
                ends = [span[1] for _, span in split.pre_tokenize_str(f"a{chr(i)}1")]
                table[i] = {(2, 3): LETTER, (1, 3): NUMBER}.get(tuple(ends), OTHER)
    return table


def split_words(text: str, classes: np.ndarray) -> list[str]:
    """The byte-level pre-tokenizer's words: runs of a class with one space before, contractions, white space."""
    n = len(text)
    if not n:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[points]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # the last white space before a word is a token of its own, or goes with the word if it is a space
    heads = np.flatnonzero(start[1:] & (kind[:-1] == BLANK)) + 1
    start[heads - 1] = True
    start[heads[points[heads - 1] == 32]] = False
    if "'" in text:
        for q in np.flatnonzero(start & (points == 39)):
            if q + 1 < n and kind[q + 1] == LETTER:
                for c in CONTRACTIONS:
                    if text.startswith(c, q + 1):
                        start[q + 1] = False
                        if q + 1 + len(c) < n:
                            start[q + 1 + len(c)] = True
                        break
    cut = np.flatnonzero(start).tolist()
    cut.append(n)
    return [text[a:b] for a, b in zip(cut, cut[1:])]  # noqa: B905


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself where it is printable Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


class Automaton:
    """The token automaton and the byte automaton made from it; built where it is used, from the vocabulary."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int], classes: np.ndarray | None = None):
        size = max([*labels, *special.values()]) + 1
        self.classes = code_point_classes() if classes is None else classes
        self.special = special
        self.born = [-1] * size  # the merge that made the state; bytes were there before
        self.state_of = [0] * size  # the state whose arcs it took over
        self.label_of = [0] * size  # the label whose arcs it was given
        self.twice = bytearray(size)
        self.cut: dict[int, int] = {}  # arcs that a merge took away: state and label -> merge
        idle: set[int] = set()
        for k, (a, b, c) in enumerate(merges):
            if a in idle or b in idle or not self._gadget(k, a, b, c):
                idle.add(c)
        self.child: dict[int, int] = {}  # the trie: node and byte -> node
        self.token_at = [-1]
        for token, label in labels.items():
            if token not in idle:
                node = 0
                for x in label:
                    node = self.child.setdefault(node << 8 | x, len(self.token_at))
                    if node == len(self.token_at):
                        self.token_at.append(-1)
                self.token_at[node] = token
        self.inner = bytearray(len(self.token_at))  # nodes with children
        for key in self.child:
            self.inner[key >> 8] = 1
        texts = [labels.get(i, b"") for i in range(size)]
        for text, token in special.items():
            texts[token] = text.encode()
        self.length = np.array([len(x) for x in texts], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = self.length.tolist()
        self._forget()

    def _gadget(self, k: int, a: int, b: int, c: int) -> bool:
        """False if the automaton has no arc from a on b by now: the merge never applies, its token never occurs."""
        if self.born[c] >= 0:
            raise ValueError(f"two merges make token {c}")
        if not self.arc(a, b):
            return False
        self.cut[a << 20 | b] = k
        self.born[c], self.state_of[c], self.label_of[c], self.twice[c] = k, b, a, a == b
        return True

    def arc(self, state: int, label: int) -> bool:
        """Whether the token automaton, with the merges so far, has an arc from the state on the label."""
        limit, born = NEVER, self.born
        while self.cut.get(state << 20 | label, NEVER) >= limit:
            s, t = born[state], born[label]
            if s < 0 and t < 0:
                return True
            if s < t and self.twice[label] and self.label_of[label] == state:
                return False
            limit = s if s > t else t
            state, label = self.state_of[state] if s >= t else state, self.label_of[label] if t >= s else label
        return False

    def _forget(self) -> None:
        """The byte automaton with its start alone."""
        self.table: dict[int, int] = {}  # transitions: state and byte -> state
        self.output = [-1]  # the token that ends at each state
        self.pairs: list[bytes] = [array("i", (-1, 0)).tobytes()]  # token state and node, one pair after the other; -1 is the start
        self.number = {self.pairs[0]: 0}

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte, by the subset construction."""
        pairs = array("i", self.pairs[state])
        out = array("i")
        ended = -1
        for at in range(0, len(pairs), 2):
            node = self.child.get(pairs[at + 1] << 8 | byte)
            if node is not None:
                if self.inner[node]:  # at a leaf nothing goes on
                    out.append(pairs[at])
                    out.append(node)
                token = self.token_at[node]
                if ended < 0 <= token and (pairs[at] < 0 or self.arc(pairs[at], token)):
                    ended = token
        if ended < 0:
            raise ValueError(f"no token for byte {byte}")
        out.append(ended)
        out.append(0)
        key = out.tobytes()
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.pairs)
            self.pairs.append(key)
            self.output.append(ended)
        self.table[state << 8 | byte] = to
        return to

    @classmethod
    def of_file(cls, content: str) -> Automaton:
        """From the content of a tokenizer file of byte-level BPE."""
        data = json.loads(content)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        vocabulary = data["model"]["vocab"]
        labels = {i: bytes(letters[x] for x in word) for word, i in vocabulary.items() if word not in special}
        merges = []
        for pair in data["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
        return cls(labels, merges, special, code_point_classes(content))

    def word(self, word: bytes) -> list[int]:
        """Tokens of a pre-split word."""
        if len(self.pairs) > MOST_STATES:
            self._forget()
        table, state, way = self.table, 0, []
        for byte in word:
            key = state << 8 | byte
            state = table[key] if key in table else self._compile(state, byte)
            way.append(state)
            if len(self.pairs) > MOST_STATES and len(way) % MOST_STATES == 0:  # one very long word fills the table by itself
                way[:] = [-1 - self.output[x] if x >= 0 else x for x in way]
                pairs = self.pairs[state]
                self._forget()
                state = self.number[pairs] = 1
                self.pairs.append(pairs)
                self.output.append(-1 - way[-1])
                table = self.table
        out, at = [], len(way)
        while at:
            last = way[at - 1]
            token = self.output[last] if last >= 0 else -1 - last
            out.append(token)
            at -= self.sizes[token]
        return out[::-1]

    def decode(self, ids: bytes) -> bytes:
        """Labels of the arcs."""
        tokens = np.frombuffer(ids, "<u4")
        size = self.length[tokens]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.offset[tokens] - ends + size, size) + np.arange(ends[-1])].tobytes()


class Encoder:
    """An automaton with the words that a worker has met."""

    def __init__(self, automaton: Automaton, encode_special: bool = True):
        self.automaton = automaton
        self.special = automaton.special if encode_special else {}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for words in self._parts(text):
            fresh = set(words).difference(known)
            if len(known) + len(fresh) > CACHE_WORDS:
                known.clear()
                fresh = set(words)
            for w in fresh:
                known[w] = array("I", self.automaton.word(w.encode())).tobytes()
            out += map(known.__getitem__, words)
            for w in fresh:
                if len(w) > CACHE_LENGTH:
                    del known[w]
        return b"".join(out)

    def _parts(self, text: str) -> Iterator[list[str]]:
        """Words of the text between special tokens, SPLIT code points or so at a time; special tokens as numbers."""
        at = 0
        while self.special:
            hits = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not hits:
                break
            i, _, s = min(hits)
            yield from self._words(text, at, i)
            own = self.known.get(s)  # what the string is as a word of plain text, if met
            self.known[s] = self.special[s].to_bytes(4, "little")
            yield [s]
            self.known.pop(s, None)
            if own is not None:
                self.known[s] = own
            at = i + len(s)
        yield from self._words(text, at, len(text))

    def _words(self, text: str, at: int, end: int) -> Iterator[list[str]]:
        """A word's split depends on what follows it alone, so the last words of a step are split again with the next."""
        step = SPLIT
        while at < end:
            words = split_words(text[at : min(at + step, end)], self.automaton.classes)
            if at + step < end:
                words = words[:-3]
                if not words:
                    step *= 2
                    continue
            yield words
            at += sum(map(len, words))


def encoder_of(content: bytes, encode_special: bool = True) -> Encoder:
    """The encoder of a tokenizer file's content; a worker process builds the automaton once and keeps its tables until it does something else."""
    name = hashlib.sha256(content).hexdigest()
    automaton = runtime.held(name, lambda: Automaton.of_file(content.decode()))
    return runtime.held(f"{name} {encode_special}", lambda: Encoder(automaton, encode_special))


def _shared(docs: DataFrame, path: str):
    """The tokenizer file's content for the tasks. The tables are built there, not on the driver."""
    runtime.prepare(docs.sparkSession)
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _digests(automaton: Automaton, rows: list[bytes]) -> list[pa.Array]:
    decoded = (automaton.decode(r).decode("utf-8", "replace").encode() for r in rows)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([sha(r) for r in rows], pa.string()), pa.array([sha(d) for d in decoded], pa.string())]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", encode_special: bool = True) -> DataFrame:
    """docs with a binary column of token ids (little-endian unsigned 32-bit). One pass, no shuffle."""
    content = _shared(docs, path)

    def make():
        encoder = encoder_of(content.value, encode_special)
        return lambda texts: [pa.array([encoder.encode(t.decode("utf-8", "replace")) for t in texts], pa.binary())]

    return runtime.append_columns(docs, text, [T.StructField(ids, T.BinaryType())], make, holds=True)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids; bytes that are no UTF-8 become U+FFFD. One pass, no shuffle."""
    content = _shared(docs, path)

    def make():
        automaton = encoder_of(content.value).automaton
        return lambda rows: [pa.array([automaton.decode(r).decode("utf-8", "replace") for r in rows], pa.string())]

    return runtime.append_columns(docs, ids, [T.StructField(text, T.StringType())], make, holds=True)


def digests(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of a column of token ids. One pass, no shuffle."""
    content = _shared(docs, path)

    def make():
        automaton = encoder_of(content.value).automaton
        return lambda rows: _digests(automaton, rows)

    return runtime.append_columns(docs, ids, DIGESTS, make, holds=True)


def encode_and_digest(docs: DataFrame, path: str, text: str = "text", ids: str | None = None, encode_special: bool = True) -> DataFrame:
    """docs without the text, with what encode (if ids names its column) and digests give, in one worker: chained, each of the two has one with tables of its own."""
    content = _shared(docs, path)

    def make():
        encoder = encoder_of(content.value, encode_special)

        def step(texts: list[bytes]):
            rows = [encoder.encode(t.decode("utf-8", "replace")) for t in texts]
            return ([pa.array(rows, pa.binary())] if ids else []) + _digests(encoder.automaton, rows)

        return step

    fields = ([T.StructField(ids, T.BinaryType())] if ids else []) + DIGESTS
    return runtime.append_columns(docs, text, fields, make, without=text, holds=True)
