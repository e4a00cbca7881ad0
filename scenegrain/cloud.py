"""Access settings of sources, and what they mean for Hadoop's file systems."""

from __future__ import annotations

from dataclasses import dataclass, field

from scenegrain.functions.text import rewrite_prefix
from scenegrain.sources.bytes import ByteSource, Retrying, Routed


@dataclass(frozen=True)
class CloudConfig:
    provider: str = "aws"
    region: str = "us-west-2"
    requester_pays: bool = False
    prefixes: dict[str, str] = field(default_factory=dict)


#: By dataset id; the first registration stays.
configs: dict[str, CloudConfig] = {}


def rewrite_url(url: str, config: CloudConfig | None) -> str:
    return rewrite_prefix(url, config.prefixes) if config else url


def bucket_settings(config: CloudConfig | None) -> dict[str, dict[str, str]]:
    """Per bucket that addresses are rewritten to: its region, and whether requests are paid or unsigned."""
    if config is None:
        return {}
    how = {"request_payer": "true"} if config.requester_pays else {"skip_signature": "true"}
    return {to.split("/")[2]: {"region": config.region, **how} for to in config.prefixes.values() if to.startswith("s3://")}


def hadoop_conf(config: CloudConfig | None) -> dict[str, str]:
    """The same as settings of the s3a file system."""
    out = {}
    for bucket, s in bucket_settings(config).items():
        at = f"fs.s3a.bucket.{bucket}"
        out[f"{at}.endpoint.region"] = s["region"]
        if "request_payer" in s:
            out[f"{at}.requester.pays.enabled"] = "true"
        else:
            out[f"{at}.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return out


def source(config: CloudConfig | None) -> ByteSource:
    """A reader's source with the settings of a dataset: its addresses rewritten, its buckets signed where requests are paid."""
    return Retrying(Routed(config.prefixes, anonymous=not config.requester_pays) if config else Routed())
