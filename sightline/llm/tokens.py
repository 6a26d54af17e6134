"""Token ids of texts by a public tokenizer, inside tasks."""

from __future__ import annotations

import base64
import re

_LOADED: dict = {}

#: Scripts for which both libraries are known to cut words alike; other texts go to the slower one.
_COMMON = re.compile("[^\x00-ɏ‐-‟]")


def vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"json": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def encoders(paths: dict[str, str]):
    """The full tokenizer, the fast one, and a pattern for the names of special tokens."""
    key = tuple(sorted(paths.items()))
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(paths["json"])
        names = [t.content for t in full.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths["ranks"], "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[key] = full, fast, re.compile("|".join(map(re.escape, names)) or "(?!)")
    return _LOADED[key]


def encode(text: str, paths: dict[str, str], names_are_text: bool = False) -> list[int]:
    """Ids as the full tokenizer gives them, without special tokens added: the name of a special token in a text becomes its
    id. With `names_are_text` such a name is ordinary text, so that no id of a special token comes out of any text."""
    full, fast, names = encoders(paths)
    if _COMMON.search(text) or (not names_are_text and names.search(text)):
        full.encode_special_tokens = names_are_text
        return full.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)
