import os

import pytest

from claimweave.llm.encoding import TOKENIZER_DIR


@pytest.fixture(scope="session")
def vocabulary():
    path = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    return path
