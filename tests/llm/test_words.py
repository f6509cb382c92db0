import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.words import slices, span_hash, windows

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ \t\n\x0b\x0c\r\x1f\x85 é中😀"), max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(1, 40), st.integers(0, 3))
def test_words_and_hashes(texts, most, offset):
    """Words as the pattern cuts them, in any slicing; equal words have equal hashes and others don't."""
    column = pa.array([*["skipped"] * offset, *texts], pa.string()).slice(offset)
    hashes: dict[str, int] = {}
    seen = 0
    for s in slices(column, most):
        low = s.lowered()
        starts, ends, first = low.words()
        values = span_hash(low.sums(), starts, ends) if len(starts) else []
        for r in range(s.rows):
            text = (texts[s.first + r] or "").translate({c: c + 32 for c in range(65, 91)})
            want = re.findall(r"[^\x20\x09-\x0D]+", text)
            own = range(first[r], first[r + 1])
            assert [bytes(low.bytes[starts[k] : ends[k]]).decode() for k in own] == want
            for k, word in zip(own, want, strict=True):
                assert hashes.setdefault(word, int(values[k])) == int(values[k])
            seen += 1
    assert seen == len(texts) and len(set(hashes.values())) == len(hashes)


def test_windows_tell_order():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(windows(h, 3)) == 5 and len(set(windows(h, 3).tolist())) == 5
    assert windows(h[:3], 3)[0] != windows(h[:3][::-1].copy(), 3)[0] and len(windows(h, 9)) == 0
