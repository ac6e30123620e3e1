"""BPE as a deterministic automaton over tokens, built by successive merge gadgets.

The first automaton has one state with a loop for every base symbol: any sequence of symbols. Each merge
(u, v) -> c, in order of rank, is one gadget. Let q be the state that arcs labelled u lead to; if q has an
arc v to r, then u is led to a new state, a copy of q without the arc v, and every state with an arc u
gets an arc c to r; the new state has none if u = v, so a run of u is paired from the left. What remains are exactly the token sequences that the merges produce, so one path
spells each word. All arcs with one label lead to one state, hence a merge adds one state at most.

States are stored as differences. ``owner`` is the label whose arcs lead to the state, ``born`` the merge
that made it, ``cut`` the rank at which an owner lost an arc; before its first loss a label leads to its
``base`` state, that of its right part when it was made. An arc c = (u, v) made by merge t is in a state iff
u was in it at t and c was not lost since. The worker fills the explicit table (state, label) -> arc from
these when a pair is first met; encoding a word is then a walk over table entries.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# characters below this have had the same classes in all Unicode versions in use
PLAIN_END = 0x530
MAX_CACHED_WORDS = 400_000
MAX_TABLE_ARCS = 2_000_000


def byte_symbols() -> list[str]:
    """Printable stand-in of every byte: visible Latin-1 characters stand for themselves, others follow from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def plain_pattern(pattern: str) -> str:
    """The split pattern for texts below PLAIN_END, with \\p{L} and \\p{N} written out as ranges."""
    for kind in "LN":
        own = [c for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind]
        runs = [(c, next(d for d in range(c, PLAIN_END + 1) if d == PLAIN_END or unicodedata.category(chr(d))[0] != kind) - 1)
                for c in own if c == 0 or unicodedata.category(chr(c - 1))[0] != kind]
        pattern = pattern.replace("\\p{%s}" % kind, "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs))
    return pattern.replace("\\s", "\\t-\\r \\x85\\xa0")


class Automaton:
    """Token automaton of a vocabulary and its ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.vocabulary = vocabulary
        self.text = {i: t for t, i in vocabulary.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.owner, self.born = [-1], [-1]
        self.cut: dict[tuple[int, int], int] = {}
        made = {vocabulary[a + b] for a, b in merges}
        self.base = {i: 0 for i in self.text if i not in made}
        self.leads_to = dict(self.base)
        self.table: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.trie = self._spelling()

    def _gadget(self, rank: int, u: int, v: int, c: int) -> None:
        if u not in self.leads_to or v not in self.leads_to or c in self.leads_to or not self._has(self.leads_to[u], v, rank):
            return
        self.leads_to[c] = self.base[c] = self.leads_to[v]
        self.leads_to[u] = len(self.owner)
        self.owner.append(u)
        self.born.append(rank)
        self.cut[u, v] = rank
        self.parts[c] = (u, rank)

    def _has(self, state: int, label: int, now: int) -> bool:
        """Is the arc in the state at merge ``now``?"""
        while True:
            s = state
            while s:
                lost = self.cut.get((self.owner[s], label))
                if lost is not None and lost <= now and lost <= self.born[s]:
                    return False
                s = self.base[self.owner[s]]
            if label not in self.parts:
                return True
            label, now = self.parts[label]

    def arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= MAX_TABLE_ARCS:
                self.table.clear()
            known = self.table[key] = self._has(state, label, 1 << 60)
        return known

    def _spelling(self) -> dict:
        """Trie of the reachable labels; under "" a node has the label spelled so far, under "end" the one that closes a word."""
        root: dict = {}
        for label in self.leads_to:
            text = self.text[label]
            closes = bool(self.suffix) and text.endswith(self.suffix)
            node = root
            for symbol in text[:-len(self.suffix)] if closes else text:
                node = node.setdefault(symbol, {})
            node["end" if closes else ""] = label
        return root

    def encode(self, symbols: str) -> list[int]:
        """Labels of the one path that spells the word. ``symbols`` has one character per byte.

        Prefix by prefix, ``state`` is where the path of the prefix ends. Labels that start there are spelled
        along the trie; of the labels that end at a prefix exactly one has an arc from the state before it.
        """
        n, arc, leads_to = len(symbols), self.arc, self.leads_to
        kind = "end" if self.suffix else ""
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        offers: list[list[tuple[int, int, int]]] = [[] for _ in range(n + 1)]
        state = 0
        for at in range(n):
            if at:
                here = offers[at]
                begin, label, _ = here[0] if len(here) == 1 else next(x for x in here if arc(x[2], x[1]))
                came[at], state = (begin, label), leads_to[label]
            node, upto = self.trie, at
            while upto < n:
                node = node.get(symbols[upto])
                if node is None:
                    break
                upto += 1
                label = node.get("" if upto < n else kind)
                if label is not None:
                    offers[upto].append((at, label, state))
            if not at and offers[n]:  # state 0 keeps every arc, so a label that spells the word is its path
                return [offers[n][0][1]]
        came[n] = next((begin, label) for begin, label, before in offers[n] if arc(before, label))
        path = []
        while n:
            n, label = came[n]
            path.append(label)
        return path[::-1]


class Codec(dict):
    """A tokenizer file: special strings, normalising, splitting, the automaton.

    As a mapping it holds what is known of each piece: its ids, and both as text, ids and labels.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.pattern = re.compile(plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.recent = re.compile(f"[{chr(PLAIN_END)}-\U0010ffff]")
        self.splitter = Tokenizer.from_str(content)
        self.symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.label = self.automaton.text | {i: s for s, i in self.special.items()}

    def pieces(self, text: str) -> list[str]:
        """Special strings and words, in order; no word can spell a special string."""
        if not self.cut or "<" not in text:
            return self._words(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._words(part))]

    def _words(self, part: str) -> list[str]:
        own = part
        if not part.isascii():
            # characters are lowered one by one, so a final sigma is no exception
            own = unicodedata.normalize("NFC", part)
            own = own.lower() if "Σ" not in own else "".join(c.lower() for c in own)
            if self.recent.search(own):
                return self._library_words(part)
        return self.pattern.findall(own.lower())

    def _library_words(self, part: str) -> list[str]:
        """Words of text whose characters newer or older Unicode tables may class in another way."""
        words = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(part))
        return [bytes([self.byte_of[c] for c in word]).decode() for word, _ in words]

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str, str]:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        if piece in self.special:
            ids = (self.special[piece],)
        else:
            ids = tuple(self.automaton.encode("".join([self.symbols[b] for b in piece.encode()])))
        known = self[piece] = (ids, " ".join(map(str, ids)), self.decode(ids))
        return known

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self[piece][0]]

    def decode(self, ids) -> str:
        """Arc labels one after another; this file has no decoder step, so a space stands between them."""
        return " ".join([self.label[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec_of(content: str) -> Codec:
    """One codec per process and tokenizer file."""
    name = hashlib.sha256(content.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(content)
    return _codecs[name]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(documents: DataFrame, tokenizer_path: str, with_tokens: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_tokens`` also ids and decoded.

    Null and empty texts have no tokens. Repeated rows each give a row; null ids stay null; other columns
    are ignored. The tokenizer file is read on the driver and sent to the workers (its size is the
    vocabulary's). Every text is encoded and decoded whole inside one narrow pass, nothing is shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        codec = codec_of(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                known = [[codec[p] for p in codec.pieces(t or "")] for t in part.column(1).to_pylist()]
                decoded = [" ".join([k[2] for k in ks]) for ks in known]
                columns = [part.column(0), pa.array([sum([len(k[0]) for k in ks]) for ks in known], pa.int64()),
                           pa.array([_sha256(" ".join([k[1] for k in ks])) for ks in known], pa.string()),
                           pa.array(list(map(_sha256, decoded)), pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_tokens:
                    columns += [pa.array([[i for k in ks for i in k[0]] for ks in known], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", F.col("text")).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_tokens else ""))
