"""Corpus operators for training data: de-duplication, quality, contamination, tokens, secrets.

Each module holds one operator; ``queries`` registers one query per operator. Nothing outside this
package imports it."""
