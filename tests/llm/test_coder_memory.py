"""Operator 9: a chunk is coded once by a worker, also where no block repeats it."""
import public_tokenizers

from pactum.llm import lexicon_bpe as L


def test_chunks_of_one_block_are_remembered(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    file = tmp_path / "lexicon.bin"
    file.write_bytes(L.lexicon_bytes(L.build_lexicon({b" abc": L.merge_word(L._vocab(path), b" abc")})))
    coder, asked = L.Coder(path, str(file)), []
    made = coder._records
    coder._records = lambda chunks: asked.extend(chunks) or made(chunks)
    text, long = "abc once 12x, abc", "y" * (L.CACHE_WORD_BYTES + 1)
    first = coder.encode([f"{text} {long}"])
    assert coder.encode([f"{text} {long}"]) == first and coder.decode(first[0]) == f"{text} {long}"
    assert sorted(asked) == sorted(["abc", " once", " 12x,", " abc", " " + long, " " + long])
