import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

HARD = [None, "", " ", "\n\n", "a", "A b", "Don't stop, it's 'quoted'!", "x,'s y.'t", "<|endoftext|> and <|ENDOFTEXT|>", "Éa é éa, ≠ ≮", "a b c\u0085d", "İI ſs K", "ΑΣ.α ΟΔΟΣ", "a.b,c;d!!?? --e 12ab34", "日本語 text، عربى", "\U0001f600\U0001f600ok", "tab\tand\x0bvt\x0cff\x1cfs", "é́."]


@pytest.fixture(scope="session")
def vocabulary():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    alphabet = ["the", "Thing", "of", ".", ",", "'s", "'", "\n", " ", " ", " ", "é", "Ü", "9", "-", "…", "“", "a", "zz"]
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(200)] + ["word " * 9000, "x" * 9000]
