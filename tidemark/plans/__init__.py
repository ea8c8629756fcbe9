"""Plans made on the driver from the manifest, and the catalogue of queries."""
