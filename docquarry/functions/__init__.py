"""docquarry.functions"""
