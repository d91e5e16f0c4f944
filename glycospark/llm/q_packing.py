"""Query 6: packing of the documents into token sequences."""

import public_tokenizers

from .catalog import query
from .common import table
from .packing import pack_texts


def tokenizer_files() -> tuple[str, str, str]:
    """Rank file, tokenizer file and split pattern of one public vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, folder):
    return pack_texts(table(spark, folder, "documents"), tokenizer_files())
