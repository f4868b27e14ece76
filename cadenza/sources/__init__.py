"""Tables in and out: the recording contract, the raw layer, the metadata store and the generator."""
