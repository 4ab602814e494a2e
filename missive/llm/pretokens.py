"""Pre-token patterns of the public tokenizers."""

from __future__ import annotations

import regex

_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Pre-tokens of byte_bpe_50k: an optional blank before letters, numbers or other characters, or white space.
BYTE_BPE = regex.compile(rf"{_ENDINGS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
#: Pre-tokens of word_bpe_49k: white space goes, numbers stand alone.
WORD_BPE = regex.compile(rf"{_ENDINGS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")
#: Control characters at which str.split() cuts though they are no white space to the tokenizers.
SEPARATORS = regex.compile("[\x1c-\x1f]")
