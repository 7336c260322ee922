"""Tokenizer/encoder profiles: which tokenizer, markers and output size."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    tokens: str  # "words" (lowercase + white space split) or "subword" (regex + greedy pieces)
    first: str  # marker put before the tokens
    last: str  # marker put after the tokens
    dim: int
    bos: str = "<s>"
    eos: str = "</s>"
    unk: str = "<unk>"
    task: str | None = None
    strict_task: bool = False  # unknown task: error (True) or id 0 (False)
    max_tokens: int | None = None  # None: no truncation, like the reference
    uses_token_types: bool = True  # v2 models take token_type_ids, v3 take task_id
    output_name: str | None = None  # model output; None means the first output

    def with_(self, **kw) -> "Profile":
        return replace(self, **kw)


# The two model families the reference drives.
WORDS768 = Profile(
    name="words768", tokens="words", first="[CLS]", last="[SEP]", dim=768,
    strict_task=False, uses_token_types=True, output_name="last_hidden_state",
)
SUBWORD1024 = Profile(
    name="subword1024", tokens="subword", first="<s>", last="</s>", dim=1024,
    task="text-matching", strict_task=True, uses_token_types=False, output_name=None,
)
