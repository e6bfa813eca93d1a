"""admitflow: citation admission and corpus preparation as PySpark DataFrame plans."""
