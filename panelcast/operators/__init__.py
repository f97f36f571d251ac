"""DataFrame → DataFrame operators over sales panels."""
