from .keys import canonical_key, micros_of_ntz, micros_of_text  # noqa: F401
