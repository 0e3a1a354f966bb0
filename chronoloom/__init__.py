"""chronoloom: interval, sequence and corpus analytics as Spark plans."""
