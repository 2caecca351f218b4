"""Settings: defaults, limits and errors."""

import pytest

from quirelake import settings


def test_settings():
    assert settings.parse(None) == settings.Settings() == settings.parse("")
    assert settings.parse("[limits]\nmax_response_bytes = 1").answer_bytes == 4096
    assert settings.parse('[paths]\ndeny = ["/x/*"]').deny == ("/x/*",)
    for bad in ("[paths", "[paths]\nallow = [1]", '[limits]\nmax_response_bytes = "many"'):
        with pytest.raises(ValueError):
            settings.parse(bad)
