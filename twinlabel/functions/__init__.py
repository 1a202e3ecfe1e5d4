"""Column functions.  Import from the submodules or from here."""

from .encoding import (  # noqa: F401
    base64_line,
    byte_length,
    data_url,
    decode_utf8_replace,
    sha256,
    valid_payload,
)
from .images import (  # noqa: F401
    acceptance_detail,
    file_format,
    final_format,
    final_mime,
    image_acceptance,
    image_size,
    mime_of,
    needs_conversion,
    page_acceptance,
    target_size,
)
from .nested import nonempty, spec_or_empty, spec_side_by_side  # noqa: F401
from .prompts import call_key, contract, render_prompt, request_body, result_payload  # noqa: F401
from .replies import (  # noqa: F401
    all_output_text,
    answer_or_empty,
    first_output_text,
    first_text_part,
    parse_json,
    parse_status,
    reply_text,
)
from .text import (  # noqa: F401
    category_match,
    error_text,
    is_blank_js,
    item_name_match,
    join_names,
    media_type,
    norm,
    strip,
    strip_code_fence,
    token_intersection,
    token_overlap_match,
    token_set,
    truncate_text,
    upstream_error,
)
from .urls import (  # noqa: F401
    absolutise,
    absolutise_all,
    attr_values,
    bare_urls,
    first_candidate,
    hint_filter,
    html_unescape,
    image_url_filter,
    og_image,
    page_text,
    raw_candidates,
    url_path_lower,
)
