"""Words of whole texts as codes into the distinct words of a batch, and public token ids by word."""

from __future__ import annotations


def text_bytes(texts):
    """(bytes, bounds) of an Arrow string array: text i is bytes[bounds[i]:bounds[i + 1]]; null is empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count or texts.type != pa.large_string():
        texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(batches, columns: int = 2, most: int = 8 << 20):
    """Record batches cut into pieces of about `most` bytes of text (the last column); a longer text comes alone."""
    import numpy as np

    for batch in batches:
        texts = batch.column(columns - 1)
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(texts)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def ascii_lower_bytes(raw):
    import numpy as np

    return raw + (((raw - np.uint8(65)) < 26) * np.uint8(32)).astype(np.uint8)


def word_bounds(raw, bounds):
    """First and last byte of every word `[^\\x20\\x09-\\x0D]+` of the texts raw[bounds[i]:bounds[i + 1]], and which bytes are in words."""
    import numpy as np

    inside = ((raw - np.uint8(9)) > 4) & (raw != 32)
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    # A text's first and last bytes bound words whatever its neighbours hold.
    filled = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    begin[first] = inside[first]
    final[last] = inside[last]
    return begin, final, inside


def coded_words(raw, bounds, begin, final, inside):
    """(codes, counts, distinct) of the words between `begin` and `final` marks."""
    import numpy as np
    import pyarrow as pa

    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, bounds))
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(final) + 1 - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), counts, coded.dictionary


def word_codes(texts, lower: bool = False):
    """(codes, counts, distinct): every word `[^\\x20\\x09-\\x0D]+` of every text in order, as codes into `distinct`.

    `counts` holds the number of words a text, `distinct` the words as an Arrow array; `lower` takes A-Z as a-z.
    """
    raw, bounds = text_bytes(texts)
    if lower:
        raw = ascii_lower_bytes(raw)
    return coded_words(raw, bounds, *word_bounds(raw, bounds))


def take_runs(lengths, codes, starts=None):
    """Positions of the ragged rows `codes` in a flat array whose row i has lengths[i] items, and the rows' lengths."""
    import numpy as np

    if starts is None:
        starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    total = int(each.sum())
    shift = np.repeat(starts[codes] - (np.cumsum(each) - each), each)
    return shift + np.arange(total), each


def sums_by_text(values, counts):
    """Sums of consecutive groups of `counts` values, empty groups 0."""
    import numpy as np

    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class WordIds:
    """Token ids under a tokenizer that lower-cases, drops white space and splits letters from signs.

    No token crosses white space, so a text's ids are those of its words. Words meet the library in lower case and
    without a comma or full stop behind their last letter, once each in a batch; up to `remember` are kept between batches.
    Words with control strings (`<|`) go as they are.
    """

    def __init__(self, path: str, remember: int = 100_000):
        import re

        import numpy as np
        from tokenizers import Tokenizer as Library

        self.library, self.bare, self.known, self.remember = Library.from_file(path), Library.from_file(path), {}, remember
        self.bare.normalizer = None
        self.letters = re.compile("[a-zß-öø-ÿ]+").fullmatch
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fresh(self, words: list[str]):
        """(flat ids, starts, lengths) of new words. Words of letters go in together: the last token of each closes a word."""
        import numpy as np

        simple = np.fromiter((self.letters(w) is not None for w in words), dtype=bool, count=len(words))
        one, other = np.flatnonzero(simple), np.flatnonzero(~simple)
        joined = [" ".join([words[k] for k in one[i:i + 1000]]) for i in range(0, len(one), 1000)]
        parts = [np.array(self.bare.encode_batch_fast([j], add_special_tokens=False)[0].ids, dtype=np.uint32) for j in joined]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        stops = np.flatnonzero(self.closes[flat]) + 1
        if len(stops) != len(one) or (len(stops) and stops[-1] != len(flat)):
            one, other, flat, stops = one[:0], np.arange(len(words)), flat[:0], stops[:0]
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[one] = np.diff(stops, prepend=0)
        rest = [flat]
        for i in range(0, len(other), 4096):
            some = other[i:i + 4096]
            ids = [e.ids for e in self.library.encode_batch_fast([words[k] for k in some], add_special_tokens=False)]
            lengths[some] = [len(x) for x in ids]
            rest.append(np.array([t for x in ids for t in x], dtype=np.uint32))
        order = np.concatenate((one, other))
        starts = np.zeros(len(words), dtype=np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(rest), starts, lengths

    def look_up(self, words: list[str]):
        """(flat ids, starts, lengths) of distinct words."""
        from itertools import repeat

        import numpy as np

        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.flat, self.start[at], self.length[at]
        flat, start, length = self.fresh([words[i] for i in new])
        at[new] = len(self.known) + np.arange(len(new))
        all_flat = np.concatenate((self.flat, flat))
        all_start, all_length = np.concatenate((self.start, start + len(self.flat))), np.concatenate((self.length, length))
        room = self.remember - len(self.known)
        if room > 0:
            # Words stand in order of their first appearance, so the first ones are the more frequent ones.
            self.known.update(zip([words[i] for i in new[:room]], at[new[:room]].tolist()))
            kept = len(self.known)
            self.flat, self.start, self.length = all_flat, all_start[:kept], all_length[:kept]
        return all_flat, all_start[at], all_length[at]

    def encode(self, texts):
        """(flat ids, number of ids of each text) of an Arrow string array."""
        import numpy as np

        given, bounds = text_bytes(texts)
        raw = ascii_lower_bytes(given)
        begin, final, inside = word_bounds(raw, bounds)
        control = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        letter = (raw - np.uint8(97)) < 26
        if len(raw) > 1:
            # Capitals of Latin-1 are 0xC3 and 0x80-0x9E but for the multiplication sign; letters of Latin-1 likewise.
            second = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            raw[1:][second & (raw[1:] < 0x9F)] += np.uint8(32)
            letter[1:] |= second
        # A comma or full stop that ends a word behind a letter is a word of its own.
        mark = final & ((raw == 44) | (raw == 46)) & ~begin
        mark[1:] &= letter[:-1]
        if len(control):
            starts, stops = np.flatnonzero(begin), np.flatnonzero(final) + 1
            for k in np.unique(np.searchsorted(starts, control, side="right") - 1):
                raw[starts[k]:stops[k]] = given[starts[k]:stops[k]]
                mark[stops[k] - 1] = False
        at = np.flatnonzero(mark)
        begin[at] = True
        final[at - 1] = True
        codes, counts, distinct = coded_words(raw, bounds, begin, final, inside)
        flat, starts, lengths = self.look_up(distinct.to_pylist())
        at, each = take_runs(lengths, codes, starts)
        return flat[at], sums_by_text(each, counts)
