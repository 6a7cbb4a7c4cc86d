"""geoloom: geodata and image-label preparation as Spark DataFrame operators."""
