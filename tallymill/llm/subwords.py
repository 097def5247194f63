"""Subword ids of a public byte-level BPE vocabulary.

``Encoder`` returns what the ``tokenizers`` library returns for the vocabulary file.
Texts whose characters both libraries split alike go through ``tiktoken``, which
holds the same vocabulary as ranks and is several times faster; any other text (rarer
scripts, or the spelling of a special token) goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which the two libraries' splitting rules were compared exhaustively in the tests.
SAFE = re.compile("[\t\n\r -~¡-¬®-ſ–—‘-„…€]*")
UNSAFE = re.compile("[^\t\n\r -~¡-¬®-ſ–—‘-„…€]")
SPECIAL = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks(name: str) -> list[tuple[bytes, int]]:
    """(bytes, id) of every token of a vocabulary of ranks."""
    with open(vocabulary(name), "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


class Encoder:
    """Text to ids, without special tokens added. Not picklable: build one in each worker."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", rank_name: str | None = "byte_bpe_50k.tiktoken", specials: bool = True):
        """``specials``: whether the spelling of a special token is that token, as in ``tokenizers``, or ordinary text."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary(json_name))
        self.full.encode_special_tokens = not specials
        self.fast, self.specials = None, specials
        if rank_name:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(ranks(rank_name)), special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and SAFE.fullmatch(text) and not (self.specials and SPECIAL in text):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids

    def array(self, text: str):
        """The ids as a numpy array."""
        if self.fast is not None and SAFE.fullmatch(text) and not (self.specials and SPECIAL in text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


#: Texts that are not cut at spaces: those not safe, with a special token's spelling, or with white space in which a cut would part a run.
WHOLE = UNSAFE.pattern + r"|[\t\n\r ] (?:[\t\n\r ]|\z)|" + re.escape(SPECIAL)


class BatchEncoder:
    """Ids of a column of texts, those of :class:`Encoder`, in which every different piece is segmented once.

    Both libraries split a text before each space that no other white space precedes, and before the last space of a
    run that a word follows, so a text's ids are those of the pieces between such spaces.
    """

    def __init__(self, json_name: str, rank_name: str | None):
        self.encoder, self.sizes = Encoder(json_name, rank_name), None
        if rank_name:
            own = ranks(rank_name)
            self.sizes = np.zeros(max(i for _, i in own) + 1, dtype=np.int64)
            self.sizes[[i for _, i in own]] = [len(token) for token, _ in own]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has); no text is null."""
        if self.sizes is None or not len(texts):
            return _in_a_row([self.encoder.array(t) for t in texts.to_pylist()])
        whole = pc.match_substring_regex(texts, WHOLE)
        cut = np.flatnonzero(~whole.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(cut)), " ", "\x01 "), "\x01")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        which, extra = coded.indices.to_numpy().astype(np.int64), texts.filter(whole).to_pylist()
        pieces, lengths = self._pieces(coded.dictionary)
        rest, rest_lengths = _in_a_row([self.encoder.array(t) for t in extra])
        # the other texts are pieces of their own
        flat, lengths = np.concatenate([pieces, rest]), np.concatenate([lengths, rest_lengths])
        counts = np.ones(len(texts), dtype=np.int64)
        counts[cut] = np.diff(bounds)
        at = np.empty(int(counts.sum()), dtype=np.int64)
        mine = np.repeat(whole.to_numpy(zero_copy_only=False), counts)
        at[~mine], at[mine] = which, len(coded.dictionary) + np.arange(len(extra))
        starts, own = np.cumsum(lengths) - lengths, lengths[at]
        ends = np.cumsum(own)
        ids = flat[np.repeat(starts[at] - ends + own, own) + np.arange(int(ends[-1]))]
        text_ends = np.append(0, ends)[np.cumsum(counts)]
        return ids, np.diff(text_ends, prepend=0)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of different pieces of safe texts; those that a space starts and a word ends go in one run."""
        joined = pc.match_substring_regex(pieces, r"\A (?s:.)*[^\t\n\r ]\z").to_numpy(zero_copy_only=False)
        run, alone = pieces.filter(pa.array(joined)), pieces.filter(pa.array(~joined)).to_pylist()
        rest, rest_lengths = _in_a_row([self.encoder.array(t) for t in alone])
        if len(run):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(run)], pa.int32()), run), "")[0].as_py()
            ids = self.encoder.array(text)
            token_ends, ends = np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(run).to_numpy().astype(np.int64))
            last = np.searchsorted(token_ends, ends)
            if (token_ends[np.minimum(last, len(ids) - 1)] != ends).any():
                raise ValueError("a token spans two words")
            lengths = np.diff(last + 1, prepend=0)
        else:
            ids, lengths = _in_a_row([])
        sizes = np.empty(len(pieces), dtype=np.int64)
        sizes[joined], sizes[~joined] = lengths, rest_lengths
        out, of_run = np.empty(int(sizes.sum()), dtype=np.uint32), np.repeat(joined, sizes)
        out[of_run], out[~of_run] = ids, rest
        return out, sizes


def _in_a_row(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.uint32), np.array([len(x) for x in lists], dtype=np.int64)
