"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, mixture, quality, secrets, simhash, tokenfile, toxicity, urlfilter, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_toxicity": toxicity.query,
    "op3_chat_format": chat.query,
    "op4_url_filter": urlfilter.query,
    "op5_mixture": mixture.query,
    "op6_quality": quality.query,
    "op7_decontaminate": decontam.query,
    "op8_warc": warc.query,
    "op9_secrets": secrets.query,
    "op10_token_ids": tokenfile.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.ORACLE,
    "op4_url_filter": urlfilter.oracle(),
    "op5_mixture": mixture.ORACLE,
    "op7_decontaminate": decontam.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_secrets": secrets.ORACLE,
}
