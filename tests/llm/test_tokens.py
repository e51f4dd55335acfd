"""Ids word by word against the tokenizer on whole texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import tokens

WHOLE = Tokenizer.from_file(tokens.VOCABULARY)
ENCODER = tokens.Encoder(tokens.VOCABULARY)


def whole(text):
    return tokens.pack(*WHOLE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ éÉßñÑçäöüÿŸİıſ'’.,!#$\n\t ́​中文字१２Σσς_-<|>0123"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    assert ENCODER.text(text.encode()) == whole(text)


def test_contractions_and_marks():
    for text in ["", " ", "it's IT'S don't. 'tis y'all'd", "Hello, World!!", "a" * 300, "x" * 65 + "!", "<|endoftext|> a<|startoftext|>b", "end..' 's", "can't... won't,'re"]:
        assert ENCODER.text(text.encode()) == whole(text), text
    assert ENCODER.text(None) == b""
