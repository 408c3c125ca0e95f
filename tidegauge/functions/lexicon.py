"""Lexicons of the article rules. All are parameters; DEFAULT holds the terms for news on one asset."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Regular expressions (matched without regard to case) and lower-case substrings.

    primary: direct mentions. lookalike: another thing by a similar name.
    specific: terms that need no second mention. footers: what ends an
    article's own text. families: (name, substrings), the first family wins.
    anchor and concrete: what a context event must mention and say.
    """

    primary: tuple[str, ...]
    lookalike: tuple[str, ...]
    specific: tuple[str, ...]
    footers: tuple[str, ...]
    families: tuple[tuple[str, tuple[str, ...]], ...]
    anchor: str
    concrete: str
    direct_family: str
    recap_family: str
    vague_family: str
    context_families: tuple[str, ...]
    locked_families: tuple[str, ...]


#: Patterns and word lists that the rules' results depend on.
DEFAULT = Lexicon(
    primary=(r"\bbitcoin\b(?!\s+cash)", r"\bbtc\b", r"\bxbt\b"),
    lookalike=(r"\bbitcoin cash\b", r"\bbch\b"),
    specific=(
        r"\bsatoshi nakamoto\b",
        r"\bsatoshis?\b",
        r"\blightning network\b",
        r"\bbitcoin core\b",
        r"\bsegwit\b",
        r"\btaproot\b",
        r"\bbitcoin halv(?:ing|en)\b",
        r"\bbitcoin miners?\b",
        r"\bbitcoin mining\b",
        r"\bbitcoin etf\b",
        r"\bspot bitcoin etf\b",
        r"\bbitcoin futures?\b",
        r"\bmt\.?\s*gox\b",
    ),
    footers=(
        r"more from the motley fool",
        r"more from fortune\.com",
        r"see original article",
        r"\brelated stor(?:y|ies)\b",
        r"\bdisclosure\b",
        r"\babout the author\b",
        r"\bauthor biography\b",
        r"\brecommended (?:articles|stories)\b",
    ),
    families=(
        ("security_hack", (" hack", " hacked", " exploit", " breach", " stolen", " ransomware", " cyberattack")),
        ("regulation_etf", (" sec ", " regulator", " regulation", " lawsuit", " court ", " legal ", " ban ", " etf ", " exchange-traded fund")),
        ("exchange_custody", (" binance", " coinbase", " kraken", " bitfinex", " bitmex", " mt. gox", " mt gox", " exchange", " custody", " custodian")),
        ("macro_liquidity", (" federal reserve", " fed ", " interest rate", " inflation", " cpi ", " monetary policy", " liquidity", " recession", " treasury", " dollar")),
        ("mining_energy", (" miner", " mining", " hashrate", " hash rate", " energy", " electricity", " halving")),
        ("stablecoin_defi", (" stablecoin", " tether", " usdt", " usdc", " defi ", " decentralized finance")),
        ("price_recap_ta", (" price analysis", " technical analysis", " support level", " resistance level", " price prediction", " market recap")),
        ("direct_bitcoin", (" bitcoin", " btc ", " xbt ", " satoshi", " lightning network")),
        ("other_crypto_context", (" crypto", " blockchain", " ethereum", " ether ", " digital asset", " cryptocurrency")),
    ),
    anchor=r"\b(bitcoin(?!\s+cash)|btc|xbt|crypto(?:currency|currencies)?|digital asset|blockchain|ethereum|ether|stablecoin|tether|usdt|usdc|coinbase|binance|kraken|bitfinex|bitmex|defi)\b",
    concrete=r"\b(approve|approved|approval|reject|rejected|ban|banned|launch|launched|listing|listed|suspend|suspended|shutdown|outage|hack|hacked|exploit|breach|stolen|lawsuit|court|regulat|investigat|adopt|partnership|acquire|acquisition|filed|filing|default|bankrupt|bankruptcy|liquidat|seiz|fine|charged|indicted)\w*\b",
    direct_family="direct_bitcoin",
    recap_family="price_recap_ta",
    vague_family="other_crypto_context",
    context_families=("regulation_etf", "exchange_custody", "macro_liquidity", "mining_energy", "stablecoin_defi", "security_hack", "other_crypto_context"),
    locked_families=("regulation_etf", "exchange_custody", "macro_liquidity", "mining_energy"),
)
