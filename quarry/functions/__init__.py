from quarry.functions.vectors import (  # noqa: F401
    dot, l2_normalize, norm, sq_l2, truncate_dims, to_double_array,
)
from quarry.functions.text import py_strip, tokens, word_slice  # noqa: F401
from quarry.functions.keys import cache_key_md5, cache_key_kwargs, cache_key_prefixed, kwargs_json  # noqa: F401
from quarry.functions.fmt import format_ms, format_seconds  # noqa: F401
