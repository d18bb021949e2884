from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerlake.llm import attention_lm as lm
from ledgerlake.llm import tokens
from ledgerlake.llm.packed import unpack

ODD = ["", None, " À b\xa0C<|x É", "x\x1cy z", " a  B\x0bÉÀ\xa0ß ", "日本 語 Hello", "it's they've 123 a--b .. c' 'd", "\x85q r", "ünï çÖdé µ ª º ÿ Ÿ x²"]
TEXTS = ODD + [f"a{chr(k)}B é{chr(k)}ö {chr(k)} {chr(k)}z" for k in range(1, 400)] + ["One two. One"] * 3


def test_columns_are_encoded_as_single_texts(monkeypatch):
    """Ids and words of whole columns, of slices, and with a table of known strings that overflows."""
    whole, one = tokens.Encoder(), tokens.Encoder()
    small = tokens.Encoder()
    small._known._most = 50
    texts = pa.array(TEXTS)
    for part in (texts, texts[3:7], texts[5:300], texts[:1], texts[:0], texts[250:]):
        for e in (whole, small):
            counted = np.arange(len(part)) % 3 > 0
            ids, at, words, count = e.encode_all(part, counted)
            want = [one.encode(t) + b"\1\0\0\0" for t in part.to_pylist()]
            assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])] == want and at[-1] == len(ids)
            own = Counter(w for t, c in zip(part.to_pylist(), counted) if c for w in lm.words_of(t))
            assert dict(zip((w.encode() for w in words.to_pylist()), count.tolist())) == own and len(words) == len(own)


def test_words_are_counted_where_texts_are_encoded(spark):
    """One pass over the texts gives the ids of all documents and the words of those that are learned from."""
    rows = lm.encoded(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3), None, 4, 9)
    assert rows.filter("bucket is null").count() == len(TEXTS)
    own = Counter(w for k, t in enumerate(TEXTS) if not lm.held_out(k) for w in lm.words_of(t))
    sent = rows.filter("bucket >= 0").collect()
    assert len({r.bucket for r in sent}) == 4 and sum(int(unpack(bytes(r.counts))[1].sum()) for r in sent) == sum(own.values())
    assert {bytes(r.word): r.c for r in lm.count_words(rows, 2).collect()} == own


def test_the_library_gets_each_piece_once(monkeypatch):
    """Strings of letters and symbols after them are put together from their pieces, over calls and after an overflow."""
    e, one, asked = tokens.Encoder(), tokens.Encoder(), []
    plain = e._known._encode
    e._known._encode = lambda words: asked.extend(words.to_pylist()) or plain(words)
    texts = pa.array(["über über! über, --- ab", "ab! ab... it's a1 \xdcBER...", "x\xa0y! über--- !ab"])
    for part in (texts[:1], texts, texts):
        ids, at, _, _ = e.encode_all(part)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [np.frombuffer(one.encode(t) + b"\1\0\0\0", "<u4").tolist() for t in part.to_pylist()]
        assert [ids[a : b - 1].tolist() for a, b in zip(at, at[1:])] == [e._whole.encode(t, add_special_tokens=False).ids for t in part.to_pylist()]
    assert {"über", "!", ",", "---", "ab", "...", "it's", "a1"} <= set(asked) and not {"über!", "ab!", "ab...", "über---"} & set(asked)
    assert len(asked) == len(set(asked))
