"""Sources: the declared schema, garage-shaped views of the driver tables,
batch-transform inputs and the bucketed table store."""
