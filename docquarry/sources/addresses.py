"""Which addresses a fetch may go to."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address ranges.
V4_FORBIDDEN = "0.0.0.0/8 169.254.0.0/16 255.255.255.255/32 224.0.0.0/4 192.0.2.0/24 198.51.100.0/24 203.0.113.0/24 192.0.0.0/24 198.18.0.0/15 240.0.0.0/4"
V4_PRIVATE = "127.0.0.0/8 10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 100.64.0.0/10"
V6_PRIVATE = "::1/128 fc00::/7"
V6_FORBIDDEN = "::/128 ff00::/8 fe80::/10 2001:db8::/32 2001:2::/48 3fff::/20 2001::/32 100::/64 64:ff9b:1::/48"
V6_PUBLIC = "2000::/3"
#: Ranges that carry an IPv4 address, and the bit its last one stands at.
V6_CARRIERS = {"::ffff:0:0/96": 0, "::ffff:0:0:0/96": 0, "64:ff9b::/96": 0, "2002::/16": 80, "::/96": 0}


def _nets(text: str) -> list:
    return [ipaddress.ip_network(x) for x in text.split()]


_FORBIDDEN4, _PRIVATE4, _PRIVATE6, _FORBIDDEN6, _PUBLIC6 = map(_nets, (V4_FORBIDDEN, V4_PRIVATE, V6_PRIVATE, V6_FORBIDDEN, V6_PUBLIC))
_CARRIERS = [(ipaddress.ip_network(k), v) for k, v in V6_CARRIERS.items()]


def classify(text: str) -> str:
    """public, private (loopback included) or forbidden; what isn't known is forbidden.
    IPv6 addresses that carry an IPv4 one are judged by it."""
    try:
        a = ipaddress.ip_address(text.strip().strip("[]").partition("%")[0])
    except ValueError:
        return "forbidden"

    def within(nets: list) -> bool:
        return any(a in n for n in nets)

    if a.version == 4:
        return "forbidden" if within(_FORBIDDEN4) else "private" if within(_PRIVATE4) else "public"
    if within(_PRIVATE6):
        return "private"
    if int(a) > 1:
        for net, shift in _CARRIERS:
            if a in net:
                return classify(str(ipaddress.IPv4Address((int(a) >> shift) & 0xFFFFFFFF)))
    return "forbidden" if within(_FORBIDDEN6) or not within(_PUBLIC6) else "public"


def allowed(text: str, allow_private: bool = False) -> bool:
    """Forbidden addresses never are."""
    kind = classify(text)
    return kind == "public" or (allow_private and kind == "private")


@F.pandas_udf(T.StringType())
def classify_udf(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else classify(x))
