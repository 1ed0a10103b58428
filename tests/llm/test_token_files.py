"""The token encoder against the library."""

from array import array

import public_tokenizers

from graphloom.llm import token_files


class Spy:
    """A tokenizer that keeps the pieces that it is asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, pieces, **options):
        self.asked += pieces
        return self.inner.encode_batch_fast(pieces, **options)


def test_pieces_of_letters_go_to_the_model_itself():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.tokenizer = spy = Spy(encoder.tokenizer)
    texts = ["", "\n", "Ab.", "one two, THREE!!", " x", "x ", "a\nb c\nd", "it's don't 1a b2", "été, où?!", "日本語 テキスト", "<|endoftext|> hi", "ﬁ ǅ Ⅷ ²", "á b", "\U00010400 ‍ q r"]
    for text in texts * 2:
        assert encoder.encode(text) == array("I", spy.inner.encode(text, add_special_tokens=False).ids).tobytes(), text
    assert not [p for p in spy.asked if p.lstrip(" ").isalpha()] and spy.asked
