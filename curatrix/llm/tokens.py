"""Token ids of whole documents through the tokenizers library.

Both supported vocabularies cut a text into pieces that they encode one by one. Documents are cut where no
piece can cross, each distinct segment of a block is encoded once by the library, and the ids are put
together again. Documents for which a cut could matter go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .kernels import LOWER, SPACE, flat, same_bytes, span_hashes, spans, words

#: Segments whose ids a worker remembers; it starts anew beyond, which changes no result.
REMEMBERED = 1 << 20
BLOCK_BYTES = 1 << 20
_SLOTS = 1 << 22


def vocabulary(name: str) -> str:
    """A vocabulary file's path; a bare name means one of the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LEADS = np.zeros(256, bool)
_LEADS[[*range(0x1C, 0x20), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _odd(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents with white space other than ASCII's six characters, or with the start of a special token."""
    at = np.flatnonzero(_LEADS[buf])
    b0, b1, b2 = buf[at], buf[np.minimum(at + 1, len(buf) - 1)], buf[np.minimum(at + 2, len(buf) - 1)]
    found = (b0 <= 0x1F) | ((b0 == 0x3C) & (b1 == 0x7C)) | ((b0 == 0xC2) & ((b1 == 0xA0) | (b1 == 0x85))) | ((b0 == 0xE1) & (b1 == 0x9A)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
    found |= (b0 == 0xE2) & (((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | ((b1 == 0x81) & (b2 == 0x9F)))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at[found], "right") - 1] = True
    return out


#: Kinds of bytes: white space, letters or parts of longer characters, digits, signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class Encoder:
    """Ids of Arrow text columns; `by_words` for vocabularies that drop white space, else segments keep it.

    Segments fall into atoms: runs of letters, digits (by words one each), signs or white space, with the one
    space before them unless by words. Each is one piece of its own, so that many of them can go to the
    library in one text. Segments with an apostrophe, a special token's start, or a character beyond ASCII
    that is no letter stay whole.
    """

    def __init__(self, name: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(vocabulary(name)), by_words
        special = [(t.content.encode(), i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.divider = special[0] if special else None
        self.closing = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if by_words:
            self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.slots = [np.full(_SLOTS, -1, np.int32) for _ in range(2)]
        self.n, self.atom = 0, np.zeros(0, bool)
        self.begin = self.size = self.first = self.length = np.zeros(0, np.int64)
        self.pool, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _find(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray, atoms: bool) -> np.ndarray:
        """The number under which each segment is remembered, by its bytes; -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        for k, slots in enumerate(self.slots):
            todo = np.flatnonzero(out < 0) if k else np.arange(len(starts))
            at = slots[((hashes[todo] >> np.uint64(32 * k)) & np.uint64(_SLOTS - 1)).astype(np.int64)]
            fit = np.flatnonzero(at >= 0)
            fit = fit[(self.length[at[fit]] == size[todo[fit]]) & (self.atom[at[fit]] == atoms)]
            todo, at = todo[fit], at[fit]
            same = same_bytes(buf, starts[todo], size[todo], self.text, self.first[at])
            out[todo[same]] = at[same]
        return out

    def _numbers(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray, found: np.ndarray, atoms: bool) -> np.ndarray:
        """found with a number for each segment: what is not remembered is encoded, once for equal bytes."""
        while len(new := np.flatnonzero(found < 0)):
            _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            number = self._learn(buf, starts[one], size[one], hashes[one], atoms)[back]
            # Equal hashes are no proof: the bytes decide.
            same = size[new] == self.length[number]
            same[same] = same_bytes(buf, starts[new[same]], size[new[same]], self.text, self.first[number[same]])
            found[new[same]] = number[same]
        return found

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for e in encode([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learn(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, hashes: np.ndarray, atoms: bool) -> np.ndarray:
        """Encode and remember segments; their numbers."""
        index = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        source, stop = buf[index].tobytes(), np.cumsum(size)
        texts = [source[a:b] for a, b in zip((stop - size).tolist(), stop.tolist())]
        pool, each = [], []
        for i in range(0, len(texts), 1 << 16):
            part = texts[i : i + (1 << 16)]
            if atoms and self.by_words:
                ids = np.concatenate(self._encode([b" ".join(part[k : k + 256]) for k in range(0, len(part), 256)]))
                ends = np.flatnonzero(self.closing[ids]) + 1
                each.append(np.diff(ends, prepend=0))
            elif atoms and self.divider is not None:
                # A special token cuts a text before anything else does; it stands after each atom.
                mark, number = self.divider
                ids = np.concatenate(self._encode([mark.join(part[k : k + 128]) + mark for k in range(0, len(part), 128)]))
                ends = np.flatnonzero(ids == number)
                each.append(np.diff(ends, prepend=-1) - 1)
                ids = np.delete(ids, ends)
            else:
                found = self._encode(part)
                ids = np.concatenate(found)
                each.append(np.fromiter(map(len, found), np.int64, len(found)))
            pool.append(ids)
        each = np.concatenate(each)
        numbers = self.n + np.arange(len(each))
        self.n += len(each)
        self.begin, self.size = np.concatenate([self.begin, len(self.pool) + np.cumsum(each) - each]), np.concatenate([self.size, each])
        self.first, self.length = np.concatenate([self.first, len(self.text) + stop - size]), np.concatenate([self.length, size])
        self.atom = np.concatenate([self.atom, np.full(len(each), atoms)])
        self.pool, self.text = np.concatenate([self.pool, *pool]), np.concatenate([self.text, np.frombuffer(source, np.uint8)])
        # A segment takes the second slot where the first is taken; the later one stays.
        at = [((hashes >> np.uint64(32 * k)) & np.uint64(_SLOTS - 1)).astype(np.int64) for k in range(2)]
        free = self.slots[0][at[0]] < 0
        self.slots[0][at[0][free]] = numbers[free]
        lost = self.slots[0][at[0]] != numbers
        self.slots[1][at[1][lost]] = numbers[lost]
        return numbers

    def _atoms(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """First bytes of the segments' parts, ascending, and the numbers under which they are remembered."""
        low = LOWER[buf] if self.by_words else buf
        kind = _KIND[low]
        cut = np.zeros(len(buf), bool)
        cut[1:] = kind[1:] != kind[:-1]
        if self.by_words:
            cut[1:] |= kind[1:] == 2
            cut &= kind > 0
        else:
            # A space belongs to the ink after it; any other white space before ink is a piece of its own.
            cut[1:] &= (kind[1:] == 0) | (buf[:-1] != 0x20)
        cut[starts] = True
        a = np.flatnonzero(cut)
        del kind
        new = np.zeros(len(buf), bool)
        new[starts] = True
        word = np.cumsum(new[a]) - 1
        e = np.minimum(np.append(a[1:], len(buf)), ends[word])
        odd = np.zeros(len(starts), bool)
        sign = low == 0x27
        sign[:-1] |= (low[:-1] == 0x3C) & (low[1:] == 0x7C)
        odd[np.searchsorted(starts, np.flatnonzero(sign), "right") - 1] = True
        h = span_hashes(low, a, e)
        number = self._find(low, a, e - a, h, True)
        doubt = np.flatnonzero((number < 0) & ~odd[word])
        # Known atoms have passed; others must be letters only, in lower case too, if they go beyond ASCII.
        if len(doubt):
            beyond = np.append(0, np.cumsum(low >= 0x80, dtype=np.int32))
            doubt = doubt[beyond[e[doubt]] > beyond[a[doubt]]]
        if len(doubt):
            text = low.tobytes()
            strange = lambda word: not word.decode("utf-8", "replace").lower().isalpha()
            ink = lambda k: [text[i:j].removeprefix(b" ") for i, j in zip(a[k].tolist(), e[k].tolist())]
            _, one, back = np.unique(h[doubt], return_index=True, return_inverse=True)
            like = doubt[one]
            bad, inks = np.zeros(len(like), bool), ink(like)
            for i in range(0, len(inks), 64):
                # Letters only, all of them together, in most cases.
                if strange(b"".join(inks[i : i + 64])):
                    bad[i : i + 64] = [strange(x) for x in inks[i : i + 64]]
            bad, like = bad[back], like[back]
            sure = (e - a)[doubt] == (e - a)[like]
            sure[sure] = same_bytes(low, a[doubt[sure]], (e - a)[doubt[sure]], low, a[like[sure]])
            for i in np.flatnonzero(~sure).tolist():
                bad[i] = strange(ink(doubt[i : i + 1])[0])
            odd[word[doubt[bad]]] = True
        if not odd.any():
            return a, self._numbers(low, a, e - a, h, number, True)
        keep = ~odd[word]
        a, e, h, number = a[keep], e[keep], h[keep], number[keep]
        number = self._numbers(low, a, e - a, h, number, True)
        b, size = starts[odd], (ends - starts)[odd]
        g = span_hashes(buf, b, b + size)
        other = self._numbers(buf, b, size, g, self._find(buf, b, size, g, False), False)
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        return np.concatenate([a, b])[order], np.concatenate([number, other])[order]

    def _segments(self, buf: np.ndarray, offsets: np.ndarray):
        # A segment begins with a document, or with the last white space before ink.
        space = SPACE[buf]
        cut = np.zeros(len(buf), bool)
        cut[:-1] = space[:-1] & ~space[1:]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        cut[last] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(buf))

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, one after another, and where each document's begin."""
        if self.n > REMEMBERED:
            self._forget()
        if self.by_words:
            starts, ends, _ = words(buf, offsets)
        else:
            starts, ends = self._segments(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, number = self._atoms(buf, starts, ends)
        begin, each = self.begin[number], self.size[number]
        at = np.concatenate([[0], np.cumsum(each)])
        ids = self.pool[np.repeat(begin - at[:-1], each) + np.arange(at[-1])]
        at = at[np.searchsorted(starts, offsets)]
        if not self.by_words and (odd := np.flatnonzero(_odd(buf, offsets))).size:
            docs = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
            for d, e in zip(odd.tolist(), self._encode([buf[offsets[d] : offsets[d + 1]].tobytes() for d in odd])):
                docs[d] = e
            at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            ids = np.concatenate(docs)
        return ids, at

    def column(self, column, end: int):
        """(first document, ids, offsets) of each block of an Arrow column, with the end id after each document."""
        buf, offsets = flat(column)
        for i, j in spans(offsets, BLOCK_BYTES):
            ids, at = self.block(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield i, np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


@lru_cache(maxsize=2)
def encoder(name: str, by_words: bool) -> Encoder:
    """The encoder of this worker process, which goes on remembering from task to task."""
    return Encoder(name, by_words)
