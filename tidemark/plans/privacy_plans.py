from pyspark.sql import functions as F

from tidemark.operators.privacy import decrypt_fields, encrypt_fields, master_keys, new_keyring
from tidemark.plans.registry import plan

# Example master keys of the queries; a user passes keys fetched at run time.
_MASTERS = {f"region-{i}": bytes([i + 1]) * 32 for i in range(5)}


def customers(t):
    """Customers with the key id of their region."""
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("region-"), "n_regionkey").alias("key_id"))
    return t.customer.join(nation, "c_nationkey").select("c_custkey", "c_name", "c_mktsegment", "key_id")


@plan("encrypt_roundtrip", "PII-1 PII-2", """
SELECT c_custkey, c_name, c_mktsegment, 'region-' || n_regionkey AS key_id FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def _(t):
    sealed = encrypt_fields(customers(t), ["c_name"], new_keyring(t.spark, _MASTERS))
    return decrypt_fields(sealed, ["c_name"], master_keys(t.spark, _MASTERS))


@plan("ciphertext_shape", "PII-1 PII-3", """
SELECT c_custkey, c_mktsegment, octet_length(encode(c_name)) + 28 AS sealed_bytes, 60 AS wrapped_bytes FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def _(t):
    sealed = encrypt_fields(customers(t), ["c_name"], new_keyring(t.spark, _MASTERS))
    return sealed.select(
        "c_custkey", "c_mktsegment", F.octet_length("c_name").cast("long").alias("sealed_bytes"), F.octet_length("wrapped_key").alias("wrapped_bytes")
    )


@plan("decrypt_unauthorised", "PII-2 ALR-17", """
SELECT c_custkey, CASE WHEN n_regionkey < 2 THEN c_name END AS c_name, n_regionkey >= 2 AS decrypt_failed
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def _(t):
    held = {k: v for k, v in _MASTERS.items() if k in ("region-0", "region-1")}
    sealed = encrypt_fields(customers(t), ["c_name"], new_keyring(t.spark, _MASTERS))
    opened = decrypt_fields(sealed, ["c_name"], master_keys(t.spark, held), strict=False)
    return opened.select("c_custkey", "c_name", "decrypt_failed")
