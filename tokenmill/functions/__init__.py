"""Column-level expressions. Every function takes and returns ``Column``s and
stays inside whole-stage codegen (built-in SQL functions and higher-order
array functions only)."""

from tokenmill.functions.text import (  # noqa: F401
    WS_CLASS, char_tokens, cut_between_markers, flatten_newlines, strip_text, whitespace_words,
)
from tokenmill.functions.ids import (  # noqa: F401
    char_decode, clean_ids, ids_text, pad_mask, pad_to, tail_window, teacher_shift,
    wrap_pad_fixed, wrap_truncate,
)
from tokenmill.functions.scores import (  # noqa: F401
    argmax, log_softmax, logsumexp, round6, softmax, token_xent, top_k, uniform_hash, order_hash,
)
