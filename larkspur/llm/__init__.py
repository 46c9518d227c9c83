"""Operators for preparing large training corpora. Nothing else imports this package."""
