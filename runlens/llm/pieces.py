"""Token ids of whole texts with a tokenizer file, at the cost of their distinct pieces.

The pre-tokenizers of these files never join what stands on both sides of certain single
blanks and line ends, nor a letter with a mark behind it. A group of texts is cut there by
Arrow, which also finds the distinct pieces; new ones are encoded by the tokenizers library,
many in one call, and Arrow puts the ids together again. The result equals the ids of the
whole text. Memory is bounded by the remembered pieces and the group in hand. Pieces are
remembered in two generations: when the younger one is full it becomes the older one, and
what is used again moves back, so that pieces in use stay and others go.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 1_400_000  # pieces, of both generations; 47 bytes each on check_l, and a look-up hashes them all
LONGEST = 64  # characters of a remembered piece
GROUP = 8_000_000  # characters of texts that are cut at once
TOGETHER = 50  # pieces in one string, with a special token between them
MARKS = ",.;:!?%&$*#"  # at the end of a piece, cut off behind a letter
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"  # a normalizer may take others apart


class Known:
    """Remembered pieces and their ids; ``used`` has the generation of each one's last use."""

    def __init__(self):
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.generation = np.zeros(0, dtype=np.int32), 0

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Places of the pieces among the remembered ones, -1 for one that is not."""
        places = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        self.used[places[places >= 0]] = self.generation
        return places

    def learn(self, pieces: pa.Array, ids: pa.Array, most: int) -> None:
        """Remember new pieces, and let go of the older generation if there are too many."""
        new = np.flatnonzero(pc.less_equal(pc.utf8_length(pieces), LONGEST).to_numpy(zero_copy_only=False))[: most // 2]
        young = np.flatnonzero(self.used == self.generation)
        if len(young) + len(new) > most // 2:
            young = young[: most - len(new)]
            self.pieces, self.ids, self.used = self.pieces.take(young), self.ids.take(young), self.used[young]
            self.generation += 1
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(new)])
        self.ids = pa.concat_arrays([self.ids, ids.take(new)])
        self.used = np.append(self.used, np.full(len(new), self.generation, dtype=np.int32))


class PieceEncoder:
    """``blanks``: blanks belong to the word behind them; else white space is dropped."""

    def __init__(self, path: str, blanks: bool, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks, self.remembered = Tokenizer.from_file(path), blanks, remembered
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: number for number, token in added.items()}
        self.mark, self.mark_id = next(iter(self.special.items()))
        self.marks = "".join(c for c in MARKS if not any(c in s for s in self.special))
        self.at_end = rf"(?P<marks>[{re.escape(self.marks)}]+)\z"
        self.known = Known()
        self.newline = self._plain("\n")

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as a text of its own."""
        everything = "\n".join(pieces)
        special = [s for s in self.special if s in everything]
        alone = {i for i, p in enumerate(pieces) if not p or any(s in p for s in special)} if special or "" in pieces else ()
        joined = [p for i, p in enumerate(pieces) if i not in alone] if alone else pieces
        sizes = [min(TOGETHER, len(joined) - i) for i in range(0, len(joined), TOGETHER)]
        texts = [self.mark.join(joined[i : i + TOGETHER]) for i in range(0, len(joined), TOGETHER)]
        ids = []
        for size, encoding in zip(sizes, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            row = np.array(encoding.ids, dtype="<u4")
            cuts = [-4, *(4 * np.flatnonzero(row == self.mark_id)).tolist(), 4 * len(row)]
            if len(cuts) != size + 1:
                raise ValueError("the tokenizer gave another number of pieces")
            raw = row.tobytes()
            ids += [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:])]
        if not alone:
            return ids
        others = iter(ids)
        return [self._plain(p) if i in alone else next(others) for i, p in enumerate(pieces)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, in order."""
        one_group = self._with_blanks if self.blanks else self._without_blanks
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from one_group(group)
                group, size = [], 0
        if group:
            yield from one_group(group)

    def _ids(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct words, and which words are odd: these have no ids of their own.

        A word with marks behind a letter has the ids of what stands before them, and theirs.
        """
        before = pc.utf8_rtrim(words, characters=self.marks)
        marked = pc.and_(pc.match_substring_regex(before, LETTER + r"\z"), pc.not_equal(before, words))
        before = pc.if_else(marked, before, words)
        places = self.known.places(before)
        new = before.filter(pa.array(places < 0)).dictionary_encode()
        pieces = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        clear = [i for i, p in enumerate(pieces) if not (self.blanks and unclear(p[1:] if p[:1] == "\n" else p))]
        if len(clear) < len(pieces):
            pieces = [pieces[i] for i in clear]
        found = self._encoded([behind(p) for p in pieces] if self.blanks else pieces)
        if self.blanks:
            found = [self.newline + x if p[0] == "\n" else x for p, x in zip(pieces, found)]
        found, clear = pa.array(found, pa.large_binary()), np.array(clear, dtype=np.int64)
        # Behind the remembered ones come those encoded now, and last no ids for the odd ones.
        nothing, old = pa.scalar(b"", pa.large_binary()), len(self.known.ids)
        row = pa.concat_arrays([self.known.ids, found, pa.array([nothing])])
        place = np.full(len(new.dictionary), len(row) - 1)
        place[clear] = old + np.arange(len(found))
        places[places < 0] = place[new.indices.to_numpy()]
        ids, odd = row.take(pa.array(places)), places == len(row) - 1
        self.known.learn(new.dictionary.take(clear), found, self.remembered)
        if pc.any(marked).as_py():
            ends = pc.struct_field(pc.extract_regex(words.filter(marked), self.at_end), 0).dictionary_encode()
            end_ids = pa.array(self._encoded(ends.dictionary.to_pylist()), pa.large_binary()).take(ends.indices)
            ids = pc.replace_with_mask(ids, marked, pc.binary_join_element_wise(ids.filter(marked), end_ids, nothing))
        return ids, odd

    def _without_blanks(self, texts: list[str]) -> Iterator[bytes]:
        words, codes, starts = cut(texts, " ")
        yield from together(self._ids(words)[0], codes, starts)

    def _with_blanks(self, texts: list[str]) -> Iterator[bytes]:
        """A piece with a line end in front stands behind a line end, others behind a blank."""
        words, codes, starts = cut(texts, " \n")
        firsts = words.take(codes[starts[:-1]]).to_pylist()
        codes[starts[:-1]] = np.arange(len(words), len(words) + len(firsts))
        ids, odd = self._ids(words)
        odd = np.append(odd, [unclear(first) for first in firsts])
        merged = {
            i: list(merged_pieces(texts[i]))
            for i in np.flatnonzero(np.logical_or.reduceat(odd[codes], starts[:-1])).tolist()
        }
        once = list({p for pieces in merged.values() for p in pieces})
        once_ids = dict(zip(once, self._encoded(once)))
        ids = pa.concat_arrays([ids, pa.array(self._encoded(firsts), pa.large_binary())])
        for i, row in enumerate(together(ids, codes, starts)):
            yield b"".join(map(once_ids.__getitem__, merged[i])) if i in merged else row


def behind(word: str) -> str:
    """The piece of a word behind a blank, or behind a line end, which it has in front."""
    return word[1:] if word[0] == "\n" else " " + word


def cut(texts: list[str], line_end: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts cut at blanks, with something else for line ends.

    Distinct words, the places of all words among them, and where each text's words start.
    """
    lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", line_end)
    parts = pc.split_pattern(lines, " ")
    words = parts.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy().copy(), parts.offsets.to_numpy()


def together(ids: pa.Array, codes: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """The ids of each text from those of its words."""
    _, offsets, data = ids.take(pa.array(codes)).buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[starts].tolist()
    for a, b in zip(places, places[1:]):
        yield data[a:b].to_pybytes() if a < b else b""


def unclear(piece: str) -> bool:
    """White space at an edge may belong together with white space beyond it."""
    return not piece or piece[0].isspace() or piece[-1].isspace()


def merged_pieces(text: str) -> Iterator[str]:
    """Pieces that start at a blank which stands behind something other than white space."""
    held: list[str] = []
    for i, part in enumerate(text.split(" ")):
        if i:
            held.append(" ")
        held.append(part)
        if part and not part[-1].isspace():
            yield "".join(held)
            held = []
    if held:
        yield "".join(held)


@lru_cache(maxsize=2)
def encoder(path: str, blanks: bool, remembered: int = REMEMBERED) -> PieceEncoder:
    """The encoder of this worker process."""
    return PieceEncoder(path, blanks, remembered)
