"""Words of the packing's tokenizer, judged once."""

import public_tokenizers
from tokenizers import Tokenizer

from rolecall.llm.packing import WordTokenizer


def test_a_cached_word_is_not_judged_again(monkeypatch):
    """A word that is held is a good one; texts with odd spaces or special tokens still go whole, before and after."""
    words = WordTokenizer(*(str(public_tokenizers.path(f"byte_bpe_50k.{kind}")) for kind in ("json", "tiktoken")))
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    special = next(iter(whole.get_added_tokens_decoder().values())).content
    texts = ["a plain text of plain words", "two  spaces", f"a {special} text", f"of{special}words", "tab\t of words", "", " ", "words\n"]
    expected = [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert list(words.encode(texts)) == expected
    judged, real = [], words._bad
    monkeypatch.setattr(words, "_bad", lambda w: judged.append(w) or real(w))
    assert list(words.encode(texts)) == expected
    assert {"plain", "text", "of", "words"}.isdisjoint(judged)
