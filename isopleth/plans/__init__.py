"""Plan helpers shared by the operators: ordering without big groups, sized joins, the layer registry."""
