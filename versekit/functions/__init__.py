"""Column -> Column text functions (JVM built-ins only)."""

from .text import (clean_name, clean_string, clean_text, clean_tokens, document_tokens,  # noqa: F401
                   double_stops, drop_short_lines, expand_contractions, extract_words, file_safe_name,
                   map_chars, min_len_tokens, normalize_markers, remove_stops, scrub_text, split_ws,
                   title_tokens)
