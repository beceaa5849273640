"""Pure helpers against plain ones on texts that hypothesis finds."""

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import tokencount
from lexmill.llm.tokens import Encoder, merge, pieces, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
MERGER = tokencount.Merger(RANKS)
WHOLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(alphabet=st.one_of(st.sampled_from("the and'sretvlmd \n\t\r 　\x1c\x85é中²Ⅷ１!?_-"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_are_the_matches_of_the_pattern(text):
    assert [i for p in pieces(text) for i in merge(p.encode(), RANKS)] == WHOLE.encode_ordinary(text)
    assert "".join(pieces(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_transducers_count_what_merging_gives(texts):
    want = [sum(len(merge(p.encode(), RANKS)) for p in pieces(t)) for t in (x.replace(tokencount.SPECIAL, "") for x in texts)]
    assert tokencount.count_batch([x.replace(tokencount.SPECIAL, "") for x in texts], MERGER).tolist() == want


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoder_is_the_words_in_turn(text):
    code = lambda w: np.array(merge(w.encode(), RANKS), dtype="<u2").tobytes()
    assert Encoder(code)(text) == b"".join(map(code, pieces(text)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 11), min_size=1, max_size=1500))
def test_chunks_compose(classes):
    to, marks = tokencount._splitter()
    state, plain = tokencount.NEW, np.zeros(len(classes), dtype=bool)
    for i, c in enumerate(classes):
        plain[i] |= bool(marks[state, c] & 1)
        if i and marks[state, c] & 2:
            plain[i - 1] = True
        state = to[state, c]
    assert (tokencount.word_marks(np.array(classes, dtype=np.uint8)) == plain).all()
