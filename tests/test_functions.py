from lakeloom.accounts import host_matches
from lakeloom.functions import passwords


def test_hash_has_its_form_and_verifies():
    stored = passwords.hashed("secret")
    assert stored.startswith("$A$005$") and len(stored) == 7 + 20 + 43
    assert passwords.verified("secret", stored) and not passwords.verified("Secret", stored) and not passwords.verified("secret", "$A$005$short")


def test_published_vector():
    # As `openssl passwd -5 -salt saltstring "Hello world!"` gives it.
    assert passwords.sha_crypt(b"Hello world!", b"saltstring") == "5B8vYYiY.CVt1RlTTf8KbXBH3hsxY/GNooZaBBGWEc5"


def test_host_patterns():
    assert host_matches("%", "x") and host_matches("10.0.%", "10.0.3.4") and host_matches("h", "h")
    assert not host_matches("10.0.%", "10.1.3.4") and not host_matches("h", "hh")
