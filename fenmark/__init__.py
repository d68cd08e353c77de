"""fenmark: leakage-controlled exceedance-risk analytics expressed as Spark plans."""
